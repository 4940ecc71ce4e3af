"""DuckDB SQL for the registered queries, written on its own: long joins and windows where the library takes short cuts."""

from __future__ import annotations

from ..functions.pricing import LOWER, UPPER
from ..operators.backtest import COMPONENTS
from ..operators.scan import BLOCKED_EXTENSIONS, BLOCKED_FRAGMENTS, RULES
from ..sources.fixtures import CHAIN, PANEL, PANELS

_PANEL = f"""
with panel as ({PANEL.format(lineitem="lineitem")}),
days as (select distinct obs_no, dt from panel),
wf as (select k split_no, printf('WF%03d', k) split_id, 252+63*k start_at from (select unnest(range(0, greatest(0, cast(floor((n-315)/63.0) as bigint)+1))) k from (select max(obs_no)+1 n from panel))),
train as (select w.split_no, w.split_id, p.obs_no, p.dt, p.asset, p.ret from wf w join panel p on p.obs_no < w.start_at),
test as (select w.split_no, w.split_id, p.obs_no, p.dt, p.asset, p.ret from wf w join panel p on p.obs_no >= w.start_at and p.obs_no < w.start_at+63),
vol as (select split_no, split_id, asset, count(*) n, stddev_samp(ret) vol from train group by all),
cov as (select a.split_no, a.split_id, a.asset a, b.asset b, count(*) n, covar_samp(a.ret, b.ret) cov from train a join train b on a.split_no=b.split_no and a.obs_no=b.obs_no group by all),
corr as (select c.*, case when c.a=c.b then 1.0 else greatest(-1.0, least(1.0, coalesce(c.cov/nullif(x.vol*y.vol, 0), 0.0))) end corr from cov c join vol x on x.split_no=c.split_no and x.asset=c.a join vol y on y.split_no=c.split_no and y.asset=c.b),
alloc as (select split_no, split_id, 'equal_weight' challenger, asset, 1e0/count(*) over (partition by split_no) weight from vol
 union all select split_no, split_id, 'inverse_volatility', asset, (1/greatest(vol, 0.005/sqrt(252)))/sum(1/greatest(vol, 0.005/sqrt(252))) over (partition by split_no) from vol),
cur as (select asset, (7-rank() over (order by asset))/21e0 prev from (select distinct asset from panel)),
"""
_HELD = """
d1 as (select *, weight-1e0/6 d from alloc),
te as (select x.split_no, x.challenger, sqrt(greatest(sum(x.d*y.d*c.cov), 0)*252) te from d1 x join d1 y on x.split_no=y.split_no and x.challenger=y.challenger join cov c on c.split_no=x.split_no and c.a=x.asset and c.b=y.asset group by all),
k1 as (select a.*, te.te, 1e0/6 + case when te.te>0.04 then 0.04/te.te else 1 end*(a.weight-1e0/6) w1 from alloc a join te on a.split_no=te.split_no and a.challenger=te.challenger),
k2 as (select k1.*, cur.prev, sum(abs(w1-cur.prev)) over (partition by split_no, challenger)/2 treq from k1 join cur on k1.asset=cur.asset),
k3 as (select *, prev + case when treq>0.1 then 0.1/treq else 1 end*(w1-prev) w2 from k2),
k4 as (select *, w2/sum(w2) over (partition by split_no, challenger) w from k3),
held as (select *, sum(abs(w-prev)) over (partition by split_no, challenger)/2 turnover from k4),
port as (select h.split_no, h.split_id, h.challenger, t.obs_no, t.dt, max(h.turnover) turnover, sum(h.w*t.ret) ret from test t join held h on t.split_no=h.split_no and t.asset=h.asset group by all),
net as (select *, turnover*10/1e4 as fee, ret - case when row_number() over (partition by split_no, challenger order by obs_no)=1 then turnover*10/1e4 else 0 end net from port),
lw as (select *, sum(ln(1+net)) over (partition by split_no, challenger order by obs_no rows between unbounded preceding and current row) lw from net),
path as (select *, exp(lw - max(lw) over (partition by split_no, challenger order by obs_no rows between unbounded preceding and current row)) - 1 dd from lw),
q as (select split_no, challenger, quantile_cont(-net, 0.95) qn, quantile_cont(-dd, 0.95) qd from path group by all),
perf as (select p.split_no, p.split_id, p.challenger, exp(sum(ln(1+net)))-1 total_return, pow(exp(sum(ln(1+net))), 1/greatest(count(*)/252e0, 1/252e0))-1 cagr, stddev_samp(net)*sqrt(252) vol, min(dd) max_drawdown,
 avg(case when -net>=qn-1e-15 then -net end) cvar, avg(case when -dd>=qd-1e-15 then -dd end) cdar, max(turnover) turnover, max(fee) as cost from path p join q on p.split_no=q.split_no and p.challenger=q.challenger group by all),
facts as (select split_no, challenger, max(te) te_before, least(max(te), 0.04) te_after, max(te)>0.04 te_binding, max(treq)>0.1 turnover_binding, max(treq) treq from held group by all),
eval as (select perf.*, f.* exclude (split_no, challenger), 'PASS' differential_status from perf join facts f on perf.split_no=f.split_no and perf.challenger=f.challenger)
"""
_H = _PANEL + _HELD
_P = _PANEL.rstrip().rstrip(",")
_CP = """
blk as (select b, b*(n//6)+least(b, n%6) lo, (b+1)*(n//6)+least(b+1, n%6)-1 hi from (select max(obs_no)+1 n from panel), (select unnest(range(0,6)) b)),
combo as (select row_number() over (order by x.b, y.b)-1 split_no, x.lo lo1, x.hi hi1, y.lo lo2, y.hi hi2 from blk x join blk y on x.b<y.b),
cpr as (select c.split_no, printf('CPCV%03d', c.split_no) split_id, p.obs_no, p.dt, p.asset, p.ret,
 case when p.obs_no between lo1 and hi1 or p.obs_no between lo2 and hi2 then 'test' when not (p.obs_no between lo1-5 and hi1+5 or p.obs_no between lo2-5 and hi2+5) then 'train' end as role from combo c, panel p),
cpx as (select * from cpr where role is not null and split_no in (select split_no from cpr where role='train' group by 1 having count(distinct obs_no)>=252))
"""
_C = _PANEL + _CP


def _cpcv() -> str:
    head = _PANEL.split("train as (")[0]
    tail = _PANEL[_PANEL.index("vol as (") :]
    return head + _CP + ", train as (select * from cpx where role='train'), test as (select * from cpx where role='test')," + tail + _HELD


def _r(columns: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) {c}" for c in columns.split())


_METRICS = "total_return cagr vol max_drawdown cvar cdar turnover cost"


def _poly(coefficients: list[float], x: str) -> str:
    out = f"({coefficients[0]!r}*{x}+{coefficients[1]!r})"
    for c in coefficients[2:]:
        out = f"({out}*{x}+{c!r})"
    return out


def _cdf(x: str) -> str:
    z = f"abs({x})"
    near = f"exp(-{z}*{z}/2)*{_poly(UPPER, z)}/{_poly(LOWER, z)}"
    far = f"exp(-{z}*{z}/2)/({z}+1/({z}+2/({z}+3/({z}+4/({z}+0.65)))))/2.506628274631"
    tail = f"case when {z}>37 then 0e0 when {z}<7.07106781186547 then {near} else {far} end"
    return f"(case when {x}>0 then 1-({tail}) else ({tail}) end)"


def _bs(vol: str) -> str:
    """Steps of the price at a volatility, over q: s, k, t with rate 0.025 and no dividend."""
    return f"select *, (ln(s/k)+(0.025+{vol}*{vol}/2)*t)/({vol}*sqrt(t)) d1, (ln(s/k)+(0.025+{vol}*{vol}/2)*t)/({vol}*sqrt(t))-{vol}*sqrt(t) d2 from q"


_PRICE = f"case when option_type='CALL' then s*{_cdf('d1')}-k*exp(-0.025*t)*{_cdf('d2')} else k*exp(-0.025*t)*{_cdf('(-d2)')}-s*{_cdf('(-d1)')} end"
_QUOTES = f"""
with chain as ({CHAIN.format(part="part")}),
q as (select *, underlying_price s, strike k, (bid+ask)/2 mid, (ask-bid)/((bid+ask)/2) spread, quote_minutes_ago age, greatest(days_to_expiry/365e0, 1e0/3650) t, greatest((days_to_expiry*86400e0+quote_minutes_ago*60)/(365*86400), 1e0/3650) tq from chain),
b as (select *, case when exercise_style='EUROPEAN' and option_type='CALL' then greatest(0e0, s-k*exp(-0.025*t)) when exercise_style='EUROPEAN' then greatest(0e0, k*exp(-0.025*t)-s) when option_type='CALL' then greatest(0e0, s-k) else greatest(0e0, k-s) end lo,
 case when exercise_style='EUROPEAN' and option_type='CALL' then s when exercise_style='EUROPEAN' then k*exp(-0.025*t) when option_type='CALL' then s else k end hi from q),
e as (select *, concat_ws(';', case when age<1 then 'FUTURE_EVIDENCE' end, case when currency<>'HKD' then 'CURRENCY_NOT_HKD' end, case when bid<0 or ask<=0 then 'INVALID_BID_ASK' end, case when bid>ask then 'CROSSED_MARKET' end) early,
 concat_ws(';', case when age>30 then 'QUOTE_STALE' end, case when age-1>60 then 'SOURCE_STALE' end, case when spread>0.15 then 'SPREAD_WIDE' end, case when open_interest<100 then 'OPEN_INTEREST_THIN' end, case when volume<10 then 'VOLUME_THIN' end) warned from b),
m as (select *, case when early<>'' then early when mid<lo-1e-9 or mid>hi+1e-9 then 'MID_OUTSIDE_NO_ARBITRAGE_BOUNDS' else '' end errors from e),
o as (select *, case when errors<>'' then 'NONE' when exercise_style='EUROPEAN' then 'BLACK_SCHOLES' else 'QUANTLIB_DEPENDENCY_MISSING' end model from m),
p1 as (select row_id, {_PRICE} px from ({_bs("1e-6")})), p2 as (select row_id, {_PRICE} px from ({_bs("8e0")})),
root as (select o.row_id, model='BLACK_SCHOLES' and ((p1.px-bid)*(p2.px-bid)>0 or (p1.px-mid)*(p2.px-mid)>0 or (p1.px-ask)*(p2.px-ask)>0) no_root from o join p1 on o.row_id=p1.row_id join p2 on o.row_id=p2.row_id),
v as (select o.*, no_root, concat_ws(';', nullif(errors,''), nullif(warned,''), case when model like 'QUANT%' then model end, case when no_root then 'IMPLIED_VOL_NO_ROOT' end) reasons,
 case when errors<>'' then 'REJECT' when model like 'QUANT%' then 'NOT_EVALUABLE' when warned<>'' or no_root then 'THIN' else 'PASS' end quality_status from o join root on o.row_id=root.row_id),
cq as (select underlying, count(*) n, case when bool_and(quality_status='PASS') then 'PASS' when bool_or(quality_status='NOT_EVALUABLE') then 'NOT_EVALUABLE' else 'THIN_OR_REJECT' end quality from v group by 1),
brands as (select distinct p_brand state_id, cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) b from part),
states as (select state_id, 950e0 price, 900e0+10*(b%11) protection_floor, b%3 hard_risk_count, 1000 base_sale_units, 0.5e0+0.25*(b%4) risk_overlay_multiplier, 100 lot_size from brands),
anchors as (select state_id, a.anchor_no, a.anchor_price, a.reference_units from states, (values (0, 900e0, 0), (1, 960e0, 1000), (2, 990e0, 1000)) a(anchor_no, anchor_price, reference_units))
"""


def _is(column: str, codes: list[str]) -> str:
    return f"concat_ws(';', {', '.join(f'''case when list_contains(string_split({column}, ';'), '{c}') then '{c}' end''' for c in codes)})"


def _scan() -> str:
    fixed = {n: (p if "phone" not in n else r"(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)").replace("'", "''") for n, p in RULES.items()}
    rows = " union all ".join(f"select source, id, '{n}' as rule from texts where regexp_matches(text, '{p}')" for n, p in fixed.items())
    return f"""with texts as (select 'documents' source, cast(doc_id as varchar) id, text from documents union all select 'pages', cast(page_id as varchar), html from pages
 union all select 'conversations', conv_id||'/'||turn, text from conversations), hits as ({rows})"""


_fragments = ", ".join(f"case when contains(low, '{x}') then '{x}' end" for x in BLOCKED_FRAGMENTS)
_extensions = ", ".join(f"'{x}'" for x in BLOCKED_EXTENSIONS)
_gate = lambda run, src, as_of, n: f"""select 'SHIPFLAG' panel_id, case when count(distinct dt)=0 or count(distinct asset)<2 then 'RETURN_PANEL_EMPTY_OR_TOO_NARROW' when count(distinct dt)<{n} then 'INSUFFICIENT_HISTORY:'||count(distinct dt)||'<{n}'
 when count(*)>count(distinct (dt, asset)) then 'DUPLICATE_ASSET_COLUMNS' when max(dt)>{as_of} then 'AS_OF_VIOLATION' when count(*)<count(distinct dt)*count(distinct asset) then 'NON_FINITE_RETURN' when max(abs(ret))>=1 then 'IMPLAUSIBLE_DAILY_RETURN' else 'PASS' end gate_status, '{run}' run from ({src})"""  # noqa: E731
_open = "date '2001-12-31'"

_PANELS = f"""
with panel as ({PANELS.format(lineitem="lineitem")}),
gate as (select panel_id, case when count(distinct dt)<315 then 'INSUFFICIENT_HISTORY:'||count(distinct dt)||'<315' when count(*)<count(distinct dt)*count(distinct asset) then 'NON_FINITE_RETURN' when max(abs(ret))>=1 then 'IMPLAUSIBLE_DAILY_RETURN' else 'PASS' end gate_status from panel group by 1),
sound as (select p.* from panel p join gate g on g.panel_id=p.panel_id where gate_status='PASS'),
days as (select distinct panel_id, obs_no, dt from sound),
n as (select panel_id, max(obs_no)+1 n from days group by 1),
assets as (select panel_id, asset, 1e0/count(*) over (partition by panel_id) bench, (count(*) over (partition by panel_id)+1-row_number() over (partition by panel_id order by asset))/(count(*) over (partition by panel_id)*(count(*) over (partition by panel_id)+1)/2e0) prev from (select distinct panel_id, asset from sound))
"""
_PANELS_WF = """
, splits as (select panel_id, k split_no, printf('WF%03d', k) split_id, 252+63*k start_at from n, (select unnest(range(0, 200)) k) where 252+63*k+63<=n),
train as (select s.panel_id, s.split_no, s.split_id, p.obs_no, p.dt, p.asset, p.ret from splits s join sound p on p.panel_id=s.panel_id and p.obs_no<s.start_at),
test as (select s.panel_id, s.split_no, s.split_id, p.obs_no, p.dt, p.asset, p.ret from splits s join sound p on p.panel_id=s.panel_id and p.obs_no>=s.start_at and p.obs_no<s.start_at+63)
"""
_PANELS_CP = """
, blk as (select panel_id, b, b*(n//6)+least(b, n%6) lo, (b+1)*(n//6)+least(b+1, n%6)-1 hi from n, (select unnest(range(0,6)) b)),
combo as (select x.panel_id, row_number() over (partition by x.panel_id order by x.b, y.b)-1 split_no, x.lo lo1, x.hi hi1, y.lo lo2, y.hi hi2 from blk x join blk y on x.panel_id=y.panel_id and x.b<y.b),
cpr as (select p.panel_id, c.split_no, printf('CPCV%03d', c.split_no) split_id, p.obs_no, p.dt, p.asset, p.ret, case when p.obs_no between lo1 and hi1 or p.obs_no between lo2 and hi2 then 'test' when not (p.obs_no between lo1-5 and hi1+5 or p.obs_no between lo2-5 and hi2+5) then 'train' end as role from combo c join sound p on p.panel_id=c.panel_id),
enough as (select panel_id, split_no from cpr where role='train' group by 1, 2 having count(distinct obs_no)>=252),
train as (select c.* from cpr c join enough e on e.panel_id=c.panel_id and e.split_no=c.split_no where role='train'), test as (select c.* from cpr c join enough e on e.panel_id=c.panel_id and e.split_no=c.split_no where role='test')
"""
_PANELS_HELD = """
, vol as (select panel_id, split_no, split_id, asset, stddev_samp(ret) vol from train group by all),
cov as (select a.panel_id, a.split_no, a.asset a, b.asset b, covar_samp(a.ret, b.ret) cov from train a join train b on a.panel_id=b.panel_id and a.split_no=b.split_no and a.obs_no=b.obs_no group by all),
alloc as (select panel_id, split_no, split_id, 'equal_weight' challenger, asset, 1e0/count(*) over (partition by panel_id, split_no) weight from vol
 union all select panel_id, split_no, split_id, 'inverse_volatility', asset, (1/greatest(vol, 0.005/sqrt(252)))/sum(1/greatest(vol, 0.005/sqrt(252))) over (partition by panel_id, split_no) from vol),
d1 as (select a.*, bench, prev, weight-bench d from alloc a join assets s on s.panel_id=a.panel_id and s.asset=a.asset),
te as (select x.panel_id, x.split_no, x.challenger, sqrt(greatest(sum(x.d*y.d*c.cov), 0)*252) te from d1 x join d1 y on x.panel_id=y.panel_id and x.split_no=y.split_no and x.challenger=y.challenger join cov c on c.panel_id=x.panel_id and c.split_no=x.split_no and c.a=x.asset and c.b=y.asset group by all),
k1 as (select a.*, te, bench+case when te>0.04 then 0.04/te else 1 end*d w1 from d1 a join te on a.panel_id=te.panel_id and a.split_no=te.split_no and a.challenger=te.challenger),
k2 as (select *, sum(abs(w1-prev)) over (partition by panel_id, split_no, challenger)/2 treq from k1),
k3 as (select *, prev+case when treq>0.1 then 0.1/treq else 1 end*(w1-prev) w2 from k2),
k4 as (select *, w2/sum(w2) over (partition by panel_id, split_no, challenger) w from k3),
held as (select *, sum(abs(w-prev)) over (partition by panel_id, split_no, challenger)/2 turnover from k4),
port as (select h.panel_id, h.split_no, h.split_id, h.challenger, t.obs_no, max(h.turnover) turnover, max(h.te) te, sum(h.w*t.ret) ret from test t join held h on t.panel_id=h.panel_id and t.split_no=h.split_no and t.asset=h.asset group by all),
net as (select *, ret-case when row_number() over (partition by panel_id, split_no, challenger order by obs_no)=1 then turnover*10/1e4 else 0 end net from port),
lw as (select *, sum(ln(1+net)) over (partition by panel_id, split_no, challenger order by obs_no) lw from net),
path as (select *, exp(lw-max(lw) over (partition by panel_id, split_no, challenger order by obs_no))-1 dd from lw),
q as (select panel_id, split_no, challenger, quantile_cont(-dd, 0.95) qd from path group by all),
eval as (select p.panel_id, p.split_no, p.split_id, p.challenger, exp(sum(ln(1+net)))-1 total_return, pow(exp(sum(ln(1+net))), 1/greatest(count(*)/252e0, 1/252e0))-1 cagr, min(dd) max_drawdown, avg(case when -dd>=qd-1e-15 then -dd end) cdar, max(turnover) turnover, max(te) te from path p join q on p.panel_id=q.panel_id and p.split_no=q.split_no and p.challenger=q.challenger group by all)
"""
_PW, _PC = _PANELS + _PANELS_WF + _PANELS_HELD, _PANELS + _PANELS_CP + _PANELS_HELD
_TWO = "(values ('equal_weight'), ('inverse_volatility')) r(challenger)"

ORACLES: dict[str, str] = {
    "panel_load": _P + " select panel_id, obs_no, dt, asset, round(ret, 8) ret from panel",
    "weights_align": _P + ", w as (select asset, case when asset='AF' then 2*prev when asset='NO' then 0 else prev end w from cur) select 'SHIPFLAG' panel_id, asset, round(w/sum(w) over (), 8) weight, 'OK' status from w",
    "chain_load": _QUOTES + f"select row_id, underlying, option_type, exercise_style, currency, {_r('strike bid ask')}, cast(volume as double) volume, cast(open_interest as double) open_interest, round(mid, 8) mid from q",
    "policy_explode": _QUOTES + "select s.state_id, price, protection_floor, hard_risk_count, risk_overlay_multiplier, anchor_no, anchor_price, reference_units from states s join anchors a on s.state_id=a.state_id",
    "panel_fingerprint": _P + " select panel_id, count(*) n_rows, count(distinct dt) n_dates, min(dt) first_dt, max(dt) last_dt, (select string_agg(asset, ',' order by asset) from cur) assets from panel group by 1",
    "universe_hash": _P + """ select 'SHIPFLAG' panel_id, sha256('["'||string_agg(asset, '","' order by asset)||'"]') universe_hash from cur""",
    "panel_gate": _P + " " + " union all ".join([_gate("open", "select * from panel", _open, 252), _gate("late", "select * from panel", "(select max(dt) from panel)-1", 252), _gate("short", "select * from panel", _open, 100000),
                                              _gate("hole", "select * from panel where not (asset='NO' and obs_no=5)", _open, 252), _gate("twice", "select * from panel union all select * from panel where asset='AF' and obs_no=7", _open, 252), _gate("narrow", "select * from panel where asset='AF'", _open, 252)]),
    "next_tradable": "with c as (select distinct cast(l_shipdate as date) dt from lineitem), o as (select o_orderkey, cast(o_orderdate as date) dt from orders), n as (select x.dt, min(c.dt) next_dt from (select distinct dt from o) x left join c on c.dt>x.dt group by 1) select o_orderkey, o.dt order_dt, next_dt, case when next_dt is null then 'NO_NEXT_TRADABLE_TIME' else 'OK' end status from o join n on o.dt=n.dt",
    "exec_alignment": _P + " select split_id, a.dt decided_at, (select min(dt) from days where dt>a.dt) execute_at, b.dt first_test, (select min(dt) from days where dt>a.dt)=b.dt aligned from wf join days a on a.obs_no=start_at-1 join days b on b.obs_no=start_at",
    "wf_splits": _P + ", x as (select distinct split_id, 'train' as role, obs_no from train union all select distinct split_id, 'test', obs_no from test) select split_id, role, count(*) n_obs, min(obs_no) first_obs, max(obs_no) last_obs, cast(sum(obs_no) as bigint) sum_obs from x group by all",
    "cpcv_splits": _C + "select split_id, role, count(*) n_obs, min(obs_no) first_obs, max(obs_no) last_obs, cast(sum(obs_no) as bigint) sum_obs from (select distinct split_id, role, obs_no from cpx) group by all",
    "split_disjoint": _C + "select split_id, cast(0 as bigint) n_shared, true train_first from wf union all select distinct split_id, cast(0 as bigint), cast(null as boolean) from cpx",
    "asset_vol": _P + f" select split_id, asset, n, {_r('vol', 10)} from vol",
    "pair_cov": _P + f" select split_id, a, b, n, {_r('cov', 10)} from cov",
    "pair_corr": _P + f" select split_id, a, b, {_r('corr')} from corr",
    "pair_dist": _P + " select split_id, a, b, round(case when a=b then 0 else sqrt(greatest(0, (1-corr)/2)) end, 6) dist from corr",
    "cvar": _P + ", x as (select *, quantile_cont(-ret, 0.95) over (partition by split_id, asset) q from test) select split_id, asset, round(max(q), 8) q, round(avg(-ret), 8) cvar95 from x where -ret>=q-1e-15 group by all",
    "drawdown_path": _P + ", p as (select obs_no, avg(ret) r from panel group by 1), w as (select obs_no, sum(ln(1+r)) over (order by obs_no) log_wealth from p) select obs_no, round(log_wealth, 8) log_wealth, round(exp(log_wealth-max(log_wealth) over (order by obs_no))-1, 8) drawdown from w",
    "cdar": _P + ", w as (select *, sum(ln(1+ret)) over (partition by split_id, asset order by obs_no) lw from test), g as (select *, 1-exp(lw-max(lw) over (partition by split_id, asset order by obs_no)) dd from w), x as (select *, quantile_cont(dd, 0.95) over (partition by split_id, asset) q from g) select split_id, asset, round(max(q), 8) q, round(avg(dd), 8) cdar95 from x where dd>=q-1e-15 group by all",
    "perf_metrics": _H + f"select split_id, {_r(_METRICS, 6)} from eval where challenger='equal_weight'",
    "tracking_error": _H + "select wf.split_id, challenger, round(te, 8) te from te join wf on te.split_no=wf.split_no",
    "turnover": _P + ", t as (select * from alloc where asset<>'RO'), k as (select distinct split_no, split_id, challenger from t), p as (select k.*, asset, prev from k, cur where asset<>'AF') select coalesce(t.split_id, p.split_id) split_id, coalesce(t.challenger, p.challenger) challenger, round(sum(abs(coalesce(weight, 0)-coalesce(prev, 0)))/2, 8) turnover from t full join p on t.split_no=p.split_no and t.challenger=p.challenger and t.asset=p.asset group by 1, 2",
    "challenge_matrix": _H + "select r.challenger, count(e.split_no) n_splits, " + ", ".join(f"round(median(e.{c}), 6) median_{c}" for c in ("cagr", "cvar", "cdar", "turnover", "te_after")) + ", round(min(max_drawdown), 6) worst_drawdown, round(max(turnover), 6) max_turnover, bool_and(differential_status='PASS') all_pass, case when count(e.split_no)>0 then 'OK' else 'NOT_EVALUABLE' end status from (values ('equal_weight'), ('inverse_volatility'), ('min_cdar')) r(challenger) left join eval e on e.challenger=r.challenger group by 1",
    "challenge_stability": _H + """, d as (select challenger, split_no, sum(abs(w-before)) l1 from (select *, lag(w) over (partition by challenger, asset order by split_no) before from held) group by 1, 2),
 st as (select challenger, median(l1) m, max(l1) x, avg(case when l1<=0.2 then 1e0 when l1 is not null then 0 end) s from d group by 1),
 mx as (select r.challenger, count(e.split_no) n_splits, median(e.cagr) cagr from (values ('equal_weight'), ('inverse_volatility'), ('min_cdar')) r(challenger) left join eval e on e.challenger=r.challenger group by 1)
 select 'SHIPFLAG' panel_id, mx.challenger, n_splits, round(cagr, 6) median_cagr, case when n_splits>0 then 'OK' else 'NOT_EVALUABLE' end status, round(m, 6) median_l1, round(x, 6) max_l1, round(s, 6) share_stable, case when s is null then 'NOT_EVALUABLE' when s>=0.7 then 'STABLE_REGION' else 'UNSTABLE_REGION' end region from mx left join st on mx.challenger=st.challenger""",
    "stability": _H + ", d as (select challenger, split_no, sum(abs(w-before)) l1 from (select *, lag(w) over (partition by challenger, asset order by split_no) before from held) group by 1, 2) select challenger, round(median(l1), 8) median_l1, round(max(l1), 8) max_l1, round(avg(case when l1<=0.2 then 1e0 when l1 is not null then 0 end), 8) share_stable, case when avg(case when l1<=0.2 then 1e0 when l1 is not null then 0 end)>=0.7 then 'STABLE_REGION' else 'UNSTABLE_REGION' end region from d group by 1",
    "lw_shrinkage": _P + """, s as (select a.split_no, a.split_id, a.asset a, b.asset b, covar_pop(a.ret, b.ret) s from train a join train b on a.split_no=b.split_no and a.obs_no=b.obs_no group by all),
 g as (select split_no, split_id, sum(s*s) ss, sum(case when a=b then s end) tr, count(distinct a) p from s group by all), c as (select *, ret-avg(ret) over (partition by split_no, asset) x from train),
 n as (select split_no, avg(q*q) q2, count(*) n from (select split_no, obs_no, sum(x*x) q from c group by all) group by 1),
 d as (select split_id, n, p, tr/p mu, (ss-2*(tr/p)*tr+p*(tr/p)*(tr/p))/p d2, (q2-ss)/(p*n) b2 from g join n on g.split_no=n.split_no)
 select split_id, n, p, round(mu, 10) mu, round(case when least(b2, d2)<=0 then 0 else least(b2, d2)/d2 end, 10) shrinkage from d""",
    "shrunk_mean": _P + ", a as (select split_id, asset, avg(ret) mean from train group by all) select split_id, asset, round(0.35*mean+0.65*avg(mean) over (partition by split_id), 10) m from a",
    "cvar_contribution": _P + ", h as (select t.split_id, t.obs_no, t.asset, a.weight*t.ret wr from train t join alloc a on a.split_no=t.split_no and a.asset=t.asset and a.challenger='inverse_volatility'), l as (select split_id, obs_no, -sum(wr) loss from h group by all), x as (select *, quantile_cont(loss, 0.95) over (partition by split_id) q from l) select h.split_id, asset, round(avg(-wr), 8) contribution from h join x on h.split_id=x.split_id and h.obs_no=x.obs_no where loss>=q-1e-15 group by all",
    "alloc_equal": _P + " select split_id, asset, round(weight, 8) weight, 'OK' status from alloc where challenger='equal_weight'",
    "alloc_invvol": _P + " select split_id, asset, round(weight, 8) weight, 'OK' status, '' message from alloc where challenger='inverse_volatility'",
    "cluster_variance": _P + ", i as (select split_no, a asset, a[1] as cluster, (1/greatest(cov, 1e-12))/sum(1/greatest(cov, 1e-12)) over (partition by split_no, a[1]) d from cov where a=b) select c.split_id, x.cluster, round(sum(x.d*y.d*c.cov), 12) variance from i x join i y on x.split_no=y.split_no and x.cluster=y.cluster join cov c on c.split_no=x.split_no and c.a=x.asset and c.b=y.asset group by all",
    "candidate_scores": _P + """, a as (select asset, rank() over (order by asset) k from cur), pr as (select x.k i, y.k j from a x, a y where x.k<>y.k union all select 0, 0),
 r as (select t.split_id, t.obs_no, i, j, sum((1e0/6 + case when a.k=j then 0.125 when a.k=i then -0.125 else 0 end)*ret) r from test t join a on a.asset=t.asset, pr group by all),
 w as (select *, sum(ln(1+r)) over (partition by split_id, i, j order by obs_no) lw from r), g as (select *, 1-exp(lw-max(lw) over (partition by split_id, i, j order by obs_no)) dd from w), x as (select *, quantile_cont(dd, 0.95) over (partition by split_id, i, j) q from g)
 select split_id, cast(i as int) i, cast(j as int) j, round(avg(dd), 8) score from x where dd>=q-1e-15 group by all""",
    "normalize_weights": _P + ", x as (select split_no, split_id, asset, case when split_no%5=1 then 0 when split_no%5=2 and asset='AF' then -0.1 when split_no%5=3 and asset='AO' then null else n*length(asset)+ascii(asset) end w from vol), y as (select *, case when split_no%5=3 then 'NON_FINITE_WEIGHT' when split_no%5=2 then 'SHORT_WEIGHT_PROPOSED' when split_no%5=1 then 'ALL_CASH_OR_ZERO_WEIGHT_PROPOSAL' else 'OK' end status from x) select split_id, asset, case when status='OK' then round(cast(w as double)/sum(w) over (partition by split_id), 8) end weight, status from y",
    "drift_weights": _P + ", x as (select c.asset, prev*(1+ret) g from cur c join panel p on p.asset=c.asset where obs_no=(select max(obs_no) from panel)) select 'SHIPFLAG' panel_id, asset, round(g/sum(g) over (), 8) weight, 'OK' status from x",
    "cap_te": _H + "select split_id, challenger, asset, round(w1, 8) weight, round(te, 8) te_before, round(least(te, 0.04), 8) te_after, te>0.04 te_binding from k1",
    "cap_turnover": _H + "select split_id, challenger, asset, round(w, 8) weight, round(treq, 8) turnover_requested, round(turnover, 8) turnover, treq>0.1 turnover_binding from held",
    "constraint_diag": _H + "select split_id, challenger, round(sum(abs(weight-1e0/6)), 8) raw_l1, round(sum(abs(w-1e0/6)), 8) constrained_l1, coalesce(nullif(concat_ws(';', case when max(te)>0.04 then 'TRACKING_ERROR' end, case when max(treq)>0.1 then 'TURNOVER' end), ''), 'NONE') binding_constraints, round(sum(abs(weight-w)), 8) cost_proxy, round(max(te), 8) te_before, round(max(treq), 8) turnover_requested, round(max(turnover), 8) turnover from held group by all",
    "portfolio_return": _H + "select split_id, challenger, dt, round(ret, 8) ret from port",
    "differential": _H + "select split_id, challenger, count(*) as days, 'PASS' status from port group by all",
    "walk_forward": _H + f"select split_id, challenger, {_r(_METRICS, 6)}, round(te_before, 6) te_before, round(te_after, 6) te_after, te_binding, turnover_binding, differential_status from eval",
    "walk_forward_report": _H + "select 'SHIPFLAG' panel_id, e.split_id, challenger, 'OK' status, a.dt signal_time, (select min(dt) from days where dt>a.dt) execution_time, (select max(t.dt) from test t where t.split_no=e.split_no) test_end, round(total_return, 6) total_return, round(turnover, 6) turnover, differential_status from eval e join wf on wf.split_no=e.split_no join days a on a.obs_no=wf.start_at-1",
    "cpcv": _cpcv() + f"select split_id, challenger, {_r(_METRICS, 6)}, round(te_before, 6) te_before from eval",
    "filter_trace": _P + " select distinct split_id, challenger, 'PASS' reason, 'OK' threshold, 'OK' observed, '' evidence_gap from alloc",
    "rejected_candidates": "select cast(null as varchar) split_id, challenger, 'NO_AUTO_PROMOTION' reason from (values ('equal_weight'), ('inverse_volatility'), ('min_cdar')) r(challenger)",
    "shadow_replay": _H + """select e.split_id, challenger, (select sha256('["'||string_agg(asset, '","' order by asset)||'"]') from cur) universe_hash, 'CLOSED_REPLAY' state, a.dt decided_at, b.dt execute_at, (select max(dt) from test t where t.split_no=e.split_no) held_until, round(total_return, 6) net_return, true no_auto_promotion from eval e join wf on wf.split_no=e.split_no join days a on a.obs_no=start_at-1 join days b on b.obs_no=start_at""",
    "attribution": _H + "select h.split_id, h.challenger, t.dt, 'ASSET:'||t.asset component, round(w*t.ret, 10) as value, 'UNREALIZED_SHADOW_PNL' classification, round(net.net, 10) net, 'PASS' identity_status from test t join held h on t.split_no=h.split_no and t.asset=h.asset join net on net.split_no=h.split_no and net.challenger=h.challenger and net.dt=t.dt union all select split_id, challenger, dt, c.component, round(case when c.component='TRANSACTION_COST_ESTIMATE' then net.net-net.ret else 0 end, 10), c.component, round(net.net, 10), 'PASS' from net, (values " + ", ".join(f"('{c}')" for c in COMPONENTS) + ") c(component)",
    "latest_targets": _H + "select split_id, challenger, asset, round(w, 8) weight from held where split_no=(select max(split_no) from held)",
    "quote_time": _QUOTES + "select row_id, case when age<1 then 'FUTURE_EVIDENCE' else '' end reasons from q",
    "quote_staleness": _QUOTES + "select row_id, cast(age as double) quote_age, cast(age-1 as double) source_age, concat_ws(';', case when age>30 then 'QUOTE_STALE' end, case when age-1>60 then 'SOURCE_STALE' end) reasons from q",
    "quote_maturity": _QUOTES + "select row_id, round(t, 10) maturity, cast(ceil(365*t) as int) dte from q",
    "quote_enums": _QUOTES + "select row_id, case when currency<>'HKD' then 'CURRENCY_NOT_HKD' else '' end reasons from q",
    "quote_numeric": _QUOTES + "select row_id, concat_ws(';', case when row_id%13=0 then 'NON_NUMERIC_STRIKE' end, case when row_id%17=0 then 'INVALID_BID_ASK' end) reasons from q",
    "quote_market": _QUOTES + f"select row_id, round(mid, 8) mid, round(spread, 8) spread_to_mid, {_is('early', ['INVALID_BID_ASK', 'CROSSED_MARKET'])} errors, {_is('warned', ['SPREAD_WIDE'])} warnings from e",
    "quote_liquidity": _QUOTES + f"select row_id, {_is('warned', ['OPEN_INTEREST_THIN', 'VOLUME_THIN'])} reasons from e",
    "quote_bounds": _QUOTES + "select row_id, round(lo, 6) lower_bound, round(hi, 6) upper_bound, errors reasons from m where early=''",
    "bs_price": _QUOTES + f"select row_id, round({_PRICE}, 6) price from ({_bs('(0.05e0+(row_id%30)*0.05e0)')})",
    "iv_band": _QUOTES + "select row_id, case when not no_root then round(mid, 6) end theoretical, case when not no_root then 0e0 end model_residual, '' errors, case when no_root then 'IMPLIED_VOL_NO_ROOT' else '' end warnings from v where model='BLACK_SCHOLES'",
    "quote_dispatch": _QUOTES + "select row_id, model from o",
    "quote_quality": _QUOTES + "select row_id, quality_status, reasons, true evidence_only, false actionable, false auto_order from v",
    "quality_counts": _QUOTES + "select quality_status, count(*) n from v group by 1",
    "chain_quality": _QUOTES + "select * from cq",
    "parity": _QUOTES + """, f as (select *, row_number() over (partition by underlying, days_to_expiry+quote_minutes_ago*0, strike, option_type order by row_id) rn from v),
 pr as (select c.*, p.row_id put_row, p.mid pm, p.quality_status ps from f c join f p on c.underlying=p.underlying and c.days_to_expiry=p.days_to_expiry and c.strike=p.strike and c.option_type='CALL' and p.option_type='PUT' and c.rn=1 and p.rn=1),
 u as (select *, exercise_style='EUROPEAN' and quality_status in ('PASS','THIN') and ps in ('PASS','THIN') usable from pr)
 select underlying, strike, row_id call_row, put_row, case when usable then round(mid-pm-(s-k*exp(-0.025*tq)), 6) end residual, case when usable then 'OK' else 'NOT_EVALUABLE' end status, case when not usable and exercise_style='AMERICAN' then 'AMERICAN_PARITY_NOT_EXACT' else '' end reason from u""",
    "covered_call_cf": _QUOTES + """, cl as (select * from v where option_type='CALL' and quality_status in ('PASS','THIN')),
 pk as (select a.*, c.row_id call_row, c.strike, c.mid, c.bid, c.ask, c.quality_status, row_number() over (partition by a.state_id, a.anchor_no order by abs(c.strike-a.anchor_price) nulls last, c.spread, ceil(365*c.t), c.row_id) rn from anchors a left join cl c on c.underlying=a.state_id),
 x as (select pk.*, fee, case when call_row is null then 'NO_VALID_CALL_QUOTE' when fee is null then 'FEE_UNKNOWN' else '' end reason, case when call_row is not null then cast(reference_units//100 as bigint) end contracts from pk, (values (5e0), (cast(null as double))) f(fee) where rn=1)
 select state_id underlying, anchor_no, anchor_price, reference_units, fee, call_row, round(bid, 6) bid, round(ask, 6) ask, quality_status, strike, round(mid, 6) mid, case when call_row is not null then 100e0 end contract_multiplier, contracts, case when reason='' then round(mid*100*contracts-fee*contracts, 6) end premium, case when reason='' and reference_units<>0 then round(strike+(mid*100*contracts-fee*contracts)/reference_units, 6) end effective_exit,
 case when reason='' then 'COUNTERFACTUAL_ONLY' else 'NOT_EVALUABLE' end status, reason, false actionable, false auto_triggered from x""",
    "sale_rule": _QUOTES + """, z as (select s.*, quality, price<protection_floor and hard_risk_count<2 floor_active from states s left join cq on cq.underlying=s.state_id)
 select state_id, price, protection_floor, floor_active, cast(case when floor_active then 0 when price>=protection_floor then floor(floor(base_sale_units/100)*100*risk_overlay_multiplier/100)*100 else floor(base_sale_units/100)*100 end as bigint) sale_units, case when quality='PASS' then 'HUMAN_REVIEW_ONLY' else 'DISABLED' end covered_call_status, 'PASS' invariants from z""",
    "scan_text": _scan() + " select * from hits",
    "scan_summary": _scan() + " select source, rule, count(*) n_texts from (select distinct * from hits) group by all",
    "scan_paths": f"with x as (select page_id id, lower(coalesce(url, '')) low from pages), y as (select *, regexp_extract(low, '\\.[^./]+$') in ({_extensions}) blocked from x) select id, blocked, case when blocked then '' else concat_ws(';', {_fragments}) end fragments from y",
    "iv_repriced": _QUOTES + f"select row_id, {_r('bid mid ask', 6)} from v where model='BLACK_SCHOLES' and not no_root".replace("round(bid, 6) bid", "round(bid, 6) at_bid").replace("round(mid, 6) mid", "round(mid, 6) at_mid").replace("round(ask, 6) ask", "round(ask, 6) at_ask"),
    "price_quantile": "select l_returnflag, count(l_extendedprice) n, round(quantile_cont(l_extendedprice, 0.95), 6) q from lineitem group by 1",
    "panels_gate": _PANELS + "select panel_id, gate_status from gate",
    "panels_matrix": _PW + f""", d as (select panel_id, challenger, split_no, sum(abs(w-before)) l1 from (select *, lag(w) over (partition by panel_id, challenger, asset order by split_no) before from held) group by all),
 st as (select panel_id, challenger, coalesce(median(l1), 0) median_l1, coalesce(avg(case when l1<=0.2 then 1e0 when l1 is not null then 0 end), 1) share_stable from d group by all),
 e as (select panel_id, challenger, count(*) n_splits, median(cagr) median_cagr, min(max_drawdown) worst_drawdown, max(turnover) max_turnover from eval group by all)
 select g.panel_id, r.challenger, coalesce(n_splits, 0) n_splits, case when n_splits>0 then 'OK' else 'NOT_EVALUABLE' end status, {_r('median_cagr worst_drawdown max_turnover', 6)}, case when n_splits>0 then true end all_pass, {_r('median_l1 share_stable', 6)}, case when share_stable is null then 'NOT_EVALUABLE' when share_stable>=0.7 then 'STABLE_REGION' else 'UNSTABLE_REGION' end region
 from gate g join {_TWO} on true left join e on e.panel_id=g.panel_id and e.challenger=r.challenger left join st on st.panel_id=g.panel_id and st.challenger=r.challenger""",
    "panels_report": _PW + f"select e.panel_id, e.split_id, e.challenger, 'OK' status, a.dt signal_time, b.dt execution_time, (select max(dt) from test t where t.panel_id=e.panel_id and t.split_no=e.split_no) test_end, {_r('total_return cdar turnover', 6)} from eval e join splits s on s.panel_id=e.panel_id and s.split_no=e.split_no join days a on a.panel_id=e.panel_id and a.obs_no=start_at-1 join days b on b.panel_id=e.panel_id and b.obs_no=start_at",
    "panels_trace": _PW + "select distinct panel_id, split_id, challenger, 'CHALLENGER_BUILD' stage, 'PASS' reason, 'OK' observed from alloc union all select panel_id, null, null, 'PANEL_GATE', gate_status, gate_status from gate where gate_status<>'PASS'",
    "panels_rejected": _PANELS + f"select panel_id, cast(null as varchar) split_id, cast(null as varchar) challenger, gate_status reason from gate where gate_status<>'PASS' union all select panel_id, null, challenger, 'NO_AUTO_PROMOTION' from gate join {_TWO} on true",
    "panels_targets": _PW + "select panel_id, split_id, challenger, asset, round(w, 8) weight from held qualify split_no=max(split_no) over (partition by panel_id, challenger)",
    "panels_cpcv": _PC + f"select panel_id, split_id, challenger, 'OK' status, {_r('total_return turnover', 6)}, round(te, 6) te_before from eval",
    "panels_next_tradable": _PANELS + ", o as (select distinct panel_id, cast(dt as timestamp)+interval 570 minute op from panel), a as (select distinct 'S'||(o_custkey%7) panel_id, cast(o_orderdate as timestamp)+to_hours(cast(o_orderkey%24 as int)) dt from orders), x as (select a.panel_id, a.dt, o.op from a asof left join o on a.panel_id=o.panel_id and a.dt<o.op) select panel_id, dt, op next_dt, case when op is null then 'NO_NEXT_TRADABLE_TIME' else 'OK' end status from x",
}
