"""DuckDB SQL of the corpus operators that SQL can express, written on its own: plain nesting and recursion where the library works by rounds."""

from __future__ import annotations

SPACES = r"[^\x20\x09-\x0D]+"
#: crc32 of a list of bytes, by the usual table of 256 entries in the column t.
_TABLE = "select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t"


def _crc32(bytes_: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_HEX = "list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: (position(h[1] in '0123456789ABCDEF') - 1) * 16 + position(h[2] in '0123456789ABCDEF') - 1)"

SHARDING = f"""
with recursive docs as (select doc_id, coalesce(text, '') x from documents),
g as (select row_number() over (order by sum(octet_length(encode(x)) + 8) desc, min(doc_id) nulls last) i, x, cast(sum(octet_length(encode(x)) + 8) as bigint) bytes from docs group by x),
lpt(i, loads, shard) as (select 0::bigint, list_transform(range(24), lambda k: 0::bigint), 0::bigint
 union all select g.i, list_transform(loads, lambda v, k: case when k = list_position(loads, list_min(loads)) then v + bytes else v end), list_position(loads, list_min(loads)) - 1 from lpt join g on g.i = lpt.i + 1),
crcs as (select i, x, cast({_crc32(_HEX)} as bigint) crc from g, ({_TABLE}))
select d.doc_id, cast(octet_length(encode(d.x)) + 8 as bigint) as size, c.crc text_crc32, 'bytes' as law, cast(l.shard as int) shard,
 row_number() over (partition by l.shard order by d.doc_id nulls last) - 1 slot, cast(null as int) grown_shard
from docs d join crcs c on c.x = d.x join lpt l on l.i = c.i
"""

_FIELD = "coalesce(octet_length(encode(cast({0} as varchar))) || ':' || {0}, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HASH = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"


def _levels(name: str, height: int) -> str:
    """Levels above {name}0 (tree, idx, d, n nodes): each node where a tree still has several becomes part of its run's digest."""
    return ",\n".join(f"{name}{k + 1} as (select tree, idx // 16 idx, case when max(n) > 1 then sha256(string_agg(d, '' order by idx)) else max(d) end d, (max(n) + 15) // 16 n from {name}{k} group by tree, idx // 16)" for k in range(height))


def _beside(name: str, k: int, shift: str, tree: str) -> str:
    """Left and right siblings of the node above (tree, shift) on level k."""
    side = "coalesce((select string_agg(o.d, '' order by o.idx) from {n}{k} o where o.n > 1 and o.tree = {t} and o.idx // 16 = ({s}) // 16 and o.idx {c} ({s})), '')"
    return "struct_pack(l := " + side.format(n=name, k=k, t=tree, s=shift, c="<") + ", r := " + side.format(n=name, k=k, t=tree, s=shift, c=">") + ")"


def merkle_manifest(source_height: int = 4, top_height: int = 3) -> str:
    """A way has a step for each level on which the node's tree still has several nodes; a run of one is a step with nothing beside."""
    steps = [_beside("s", k, f"p.i // {16**k}", "p.tree") for k in range(source_height)] + [_beside("u", k, f"p.tree // {16**k}", "0") for k in range(top_height)]
    real = [f"(p.n + {16**k - 1}) // {16**k} > 1" for k in range(source_height)] + [f"(p.trees + {16**k - 1}) // {16**k} > 1" for k in range(top_height)]
    folds, at = [], "start"
    for k in range(len(steps)):
        folds.append(f"f{k + 1} as (select * exclude (a), case when real[{k + 1}] then sha256(way[{k + 1}].l || a || way[{k + 1}].r) else a end a from {'f' + str(k) if k else 'ways'})")
        at = f"f{k + 1}"
    return f"""
with docs as (select *, {_HASH.format(_FIELD.format("text"))} leaf, {_crc32("list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)")} % 5 = 0 hit, {_HASH.format("coalesce(octet_length(encode(" + _LOWER + ")) || ':' || " + _LOWER + ", '-')")} lowered from documents, ({_TABLE})),
p as (select doc_id, leaf, case when hit then lowered else leaf end a, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i, dense_rank() over (order by source nulls first) - 1 tree, count(*) over (partition by source) n, (select count(*) from (select distinct source from docs)) trees from docs),
s0 as (select tree, i idx, leaf d, n from p),
{_levels("s", source_height)},
u0 as (select 0 tree, tree idx, d, count(*) over () n from s{source_height}),
{_levels("u", top_height)},
ways as (select p.*, [{", ".join(steps)}] way, [{", ".join(real)}] real from p),
{", ".join(folds)}
select f.doc_id, f.leaf, s.d subroot, u.d root, sha256(array_to_string(list_transform(way, lambda w: w.l || w.r), '')) proof_sha256, f.a folded_root, f.a = u.d verified
from {at} f join s{source_height} s on s.tree = f.tree, u{top_height} u
"""


FILTER_AUDIT = f"""
with docs as (select doc_id, coalesce(lang, '') part, coalesce(text, '') x from documents),
words as (select *, regexp_extract_all(x, '{SPACES}') w from docs),
least as (select x, min(doc_id) lowest from docs group by x),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
flags as (select part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_extract_all(d.x, '[A-Z]')) > 10 * length(d.x), regexp_matches(d.x, '[#$%&*|]'), coalesce(d.doc_id > lowest, false)] fails, coalesce(good, 0) good, coalesce(toxic, 0) toxic
 from words d join least l on l.x = d.x left join marks m on m.doc_id = d.doc_id),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) f),
orders as (select a.f || b.f || c.f || d.f || e.f filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select filter_order, step, ascii(filter_order[step]) - 64 k, list_transform(string_split(left(filter_order, step - 1), ''), lambda l: ascii(l) - 64) earlier from orders, (select unnest(range(1, 6)) step)),
same as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from flags group by part, fails),
each as (select part, filter_order, step, k, n, good, toxic, fails[k] own, step > 1 and list_contains(list_transform(earlier, lambda j: coalesce(fails[j], false)), true) gone, len(list_filter(fails, lambda v: v)) fail_count from same, steps),
made as (select part, filter_order, step, k, coalesce(sum(n) filter (not own and not gone), 0) kept, coalesce(sum(n) filter (own and not gone), 0) removed, coalesce(sum(n) filter (own and gone), 0) redundant,
 coalesce(sum(n) filter (own and fail_count = 1), 0) unique_fails, coalesce(sum(good) filter (own and not gone), 0) good_lost, coalesce(sum(toxic) filter (own and not gone), 0) toxic_lost from each group by all)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
 cast(sum(removed) over (partition by part, k) as bigint) shapley from made
"""

ORACLES = {"op11_sharding": SHARDING, "op12_merkle_manifest": merkle_manifest(), "op13_filter_audit": FILTER_AUDIT}
