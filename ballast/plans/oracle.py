"""DuckDB statements for the registered queries, written from the definitions, not from the plans."""

from __future__ import annotations

from datetime import datetime

from ballast.operators.scoring import BayesScorer
from ballast.schema import BACKTEST_STEPS, NO_PRIZE, PRIZES, TUNED
from ballast.sources import reports

P = TUNED
#: The reports' clock.
CLOCK = datetime(2026, 1, 1)
_LISTS = ", ".join(f"({r}, {b}, {a}, '{t}', {k})" for r, b, a, t, k in PRIZES)
_DRAWS = """
nums AS (SELECT range AS ball FROM range(1, 34)),
picks AS (
  SELECT o_orderkey AS issue, o_custkey, o_orderdate, ball,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY ((o_orderkey + 1) * 7919 + ball * 104729 + (o_custkey % 97) * ball * ball * 31) % 10007, ball) AS rn
  FROM orders CROSS JOIN nums),
draws AS (
  SELECT issue, row_number() OVER (ORDER BY issue) - 1 AS idx, list_sort(list(ball)) AS reds, (issue * 31 + any_value(o_custkey) * 17) % 16 + 1 AS blue,
         CAST(any_value(o_orderdate) AS DATE) AS draw_date, CAST(sum(CAST(1 AS BIGINT) << CAST(ball AS INT)) AS BIGINT) AS mask
  FROM picks WHERE rn <= 6 GROUP BY issue)"""
_FEAT = """,
feats AS (
  SELECT issue, idx, blue, reds, list_sum(reds) AS red_sum, reds[6] - reds[1] AS red_span, len(list_filter(reds, lambda x: x % 2 = 1)) AS odd_count,
         len(list_filter(reds, lambda x: x <= 11)) AS red_zone_small, len(list_filter(reds, lambda x: x BETWEEN 12 AND 22)) AS red_zone_medium, len(list_filter(reds, lambda x: x >= 23)) AS red_zone_large,
         len(list_filter(reds, lambda x: x > 16)) AS red_big_count, len(list_filter(reds, lambda x: list_contains([2,3,5,7,11,13,17,19,23,29,31], x))) AS red_prime_count, list_sum(reds) % 10 AS red_sum_tail,
         len(list_filter([1,2,3,4,5], lambda i: reds[i+1] - reds[i] = 1 AND (i = 1 OR reds[i] - reds[i-1] <> 1))) AS red_consecutive_groups,
         len(list_distinct(flatten(list_transform([1,2,3,4,5], lambda i: list_transform(range(i + 1, 7), lambda j: reds[j] - reds[i]))))) AS red_ac_value,
         len(list_distinct(list_transform(reds, lambda x: x % 10))) AS red_tail_uniques
  FROM draws)"""
_WINDOWED = """,
windowed AS (
  SELECT issue, idx, lag(blue) OVER o AS blue_lag1, lag(red_sum) OVER o AS red_sum_lag1, lag(odd_count) OVER o AS odd_count_lag1,
         CASE WHEN count(*) OVER w = 5 THEN avg(red_sum) OVER w END AS red_sum_ma5, CASE WHEN count(*) OVER w = 5 THEN avg(odd_count) OVER w END AS odd_count_ma5, CASE WHEN count(*) OVER w = 5 THEN avg(blue) OVER w END AS blue_ma5
  FROM feats WINDOW o AS (ORDER BY idx), w AS (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
#: Statistics, probabilities, scores and ranks for each step in steps(step).
_SCORE = f""",
n_draws AS (SELECT count(*) AS n FROM draws),
balls AS (SELECT idx, 'red' AS color, unnest(reds) AS ball FROM draws UNION ALL SELECT idx, 'blue', blue FROM draws),
grid AS (SELECT step, color, ball FROM steps, (SELECT 'red' AS color, range AS ball FROM range(1, 34) UNION ALL SELECT 'blue', range FROM range(1, 17))),
seen AS (SELECT step, color, ball, sum(pow({P.decay_factor}, step - 1 - idx)) AS freq, step - max(idx) - 1 AS omission FROM steps JOIN balls ON idx < step GROUP BY step, color, ball),
stats AS (SELECT g.step, g.color, g.ball, coalesce(freq, 0) AS freq, coalesce(omission, g.step) AS omission FROM grid g LEFT JOIN seen s USING (step, color, ball)),
odds AS (SELECT idx, len(list_filter(reds, lambda x: x % 2 = 1)) AS odd FROM draws),
pairs AS (SELECT idx + 1 AS idx, odd FROM odds WHERE idx >= 5),
cond AS (SELECT step, odd FROM steps JOIN odds ON idx = step - 1),
n_all AS (SELECT step, count(*) AS n_all FROM cond JOIN pairs USING (odd) WHERE idx < step GROUP BY step),
n_hit AS (SELECT step, color, ball, count(*) AS n_hit FROM cond JOIN pairs p USING (odd) JOIN balls b ON b.idx = p.idx WHERE p.idx < step GROUP BY ALL),
probs AS (SELECT g.step, g.color, g.ball, (coalesce(n_hit, 0) + 1) / (coalesce(n_all, 0) + 2) AS prob FROM grid g LEFT JOIN n_all USING (step) LEFT JOIN n_hit USING (step, color, ball)),
normed AS (SELECT *, freq / coalesce(nullif(max(freq) OVER w, 0), 1) AS nf, omission / coalesce(nullif(max(omission) OVER w, 0), 1) AS no FROM stats JOIN probs USING (step, color, ball) WINDOW w AS (PARTITION BY step, color)),
scored AS (SELECT *, round(CASE WHEN color = 'red' THEN {P.weight_freq} * nf + {P.weight_omission} * no + {P.weight_ml} * prob ELSE {P.weight_blue_freq} * nf + {P.weight_blue_ml} * prob END, 9) AS score FROM normed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY step, color ORDER BY score DESC, ball) AS rn FROM scored)"""
#: Naive Bayes instead of the counts by odd reds.
_VALUES = BayesScorer.VALUES
_BAYES = f""",
state AS (UNPIVOT (SELECT idx, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _VALUES)} FROM feats) ON COLUMNS(* EXCLUDE idx) INTO NAME feature VALUE value),
n_values AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _VALUES.items())}) t(feature, n_values)),
learned AS (SELECT idx + 1 AS idx, feature, value FROM state WHERE idx >= 5),
given AS (SELECT step, feature, value FROM steps JOIN state ON idx = step - 1),
by_value AS (SELECT step, feature, count(l.idx) AS n_value FROM given g LEFT JOIN learned l USING (feature, value) WHERE l.idx < step GROUP BY ALL),
by_ball AS (SELECT step, color, ball, count(*) AS n_came FROM steps JOIN balls ON idx > 5 AND idx < step GROUP BY ALL),
by_both AS (SELECT g.step, g.feature, b.color, b.ball, count(*) AS n_both FROM given g JOIN learned l USING (feature, value) JOIN balls b ON b.idx = l.idx WHERE l.idx < g.step GROUP BY ALL),
every AS (SELECT g.step, g.color, g.ball, v.feature, v.n_values, coalesce(n_value, 0) AS n_value, coalesce(n_came, 0) AS n_came, coalesce(n_both, 0) AS n_both, g.step - 6 AS n
  FROM grid g CROSS JOIN n_values v LEFT JOIN by_value x ON x.step = g.step AND x.feature = v.feature LEFT JOIN by_ball y ON y.step = g.step AND y.color = g.color AND y.ball = g.ball
  LEFT JOIN by_both z ON z.step = g.step AND z.feature = v.feature AND z.color = g.color AND z.ball = g.ball),
bayes AS (SELECT step, color, ball, 1 / (1 + exp(-(any_value(ln((n_came + 1) / (n - n_came + 1))) + sum(ln((n_both + 1) / (n_came + n_values)) - ln((n_value - n_both + 1) / (n - n_came + n_values)))))) AS prob FROM every GROUP BY step, color, ball)"""


def _with_bayes(statement: str) -> str:
    """A statement whose probabilities are naive Bayes's."""
    head, tail = statement.split(",\nnormed AS", 1)
    return head.replace(_DRAWS, _DRAWS + _FEAT) + _BAYES + ",\nnormed AS" + tail.replace("stats JOIN probs USING", "stats JOIN bayes USING", 1)


_ONE_STEP = ",\nsteps AS (SELECT count(*) AS step FROM draws)"
_LAST_50 = ",\nsteps AS (SELECT idx AS step FROM draws WHERE idx >= (SELECT count(*) FROM draws) - 50)"

_BEFORE_LAST = ",\nsteps AS (SELECT count(*) - 1 AS step FROM draws)"

_BITS = "bit_count(CAST({} AS BIGINT))"
_RULES = {
    "r1_not_regular": "len(list_distinct([b2-b1, b3-b2, b4-b3, b5-b4, b6-b5])) > 1",
    "r2_sum": "b1+b2+b3+b4+b5+b6 BETWEEN 70 AND 160",
    "r3_span": "b6 - b1 >= 15",
    "r4_runs": "NOT ((b2-b1=1)::INT + (b3-b2=1 AND b2-b1<>1)::INT + (b4-b3=1 AND b3-b2<>1)::INT + (b5-b4=1 AND b4-b3<>1)::INT + (b6-b5=1 AND b5-b4<>1)::INT >= 3 OR b4-b1=3 OR b5-b2=3 OR b6-b3=3)",
    "r5_zones": "NOT (b6 <= 11 OR (b1 >= 12 AND b6 <= 22) OR b1 >= 23)",
    "r6_ac": "len(list_distinct([b2-b1,b3-b1,b4-b1,b5-b1,b6-b1,b3-b2,b4-b2,b5-b2,b6-b2,b4-b3,b5-b3,b6-b3,b5-b4,b6-b4,b6-b5])) - 5 BETWEEN 6 AND 10",
    "r7_primes": "(b1 IN (1,2,3,5,7,11,13,17,19,23,29,31))::INT + (b2 IN (2,3,5,7,11,13,17,19,23,29,31))::INT + (b3 IN (3,5,7,11,13,17,19,23,29,31))::INT + (b4 IN (5,7,11,13,17,19,23,29,31))::INT + (b5 IN (5,7,11,13,17,19,23,29,31))::INT + (b6 IN (7,11,13,17,19,23,29,31))::INT BETWEEN 2 AND 4",
    "r8_big_small": "(b1<=16)::INT+(b2<=16)::INT+(b3<=16)::INT+(b4<=16)::INT+(b5<=16)::INT+(b6<=16)::INT BETWEEN 2 AND 4",
    "r11_odd_even": "6 - (b1%2+b2%2+b3%2+b4%2+b5%2+b6%2) BETWEEN 2 AND 4",
    "r12_mod3": "len(list_distinct([b1%3,b2%3,b3%3,b4%3,b5%3,b6%3])) = 3",
    "r13_tails": "list_max(list_transform(range(0, 10), lambda t: (b1%10=t)::INT+(b2%10=t)::INT+(b3%10=t)::INT+(b4%10=t)::INT+(b5%10=t)::INT+(b6%10=t)::INT)) < 3",
    "r14_head_tail": "b1 <= 10 AND b6 >= 25",
    "r15_tail_sum": "b1%10+b2%10+b3%10+b4%10+b5%10+b6%10 BETWEEN 15 AND 45",
}
_APPLIED = " AND ".join(f"({v})" for k, v in _RULES.items() if k != "r7_primes")
_MASK = "(1::BIGINT << b1) | (1::BIGINT << b2) | (1::BIGINT << b3) | (1::BIGINT << b4) | (1::BIGINT << b5) | (1::BIGINT << b6)"
_ALL = f"""balls33 AS (SELECT CAST(range AS INT) AS b FROM range(1, 34)),
combos AS (SELECT *, {_MASK} AS mask FROM (SELECT t1.b AS b1, t2.b AS b2, t3.b AS b3, t4.b AS b4, t5.b AS b5, t6.b AS b6
  FROM balls33 t1 JOIN balls33 t2 ON t2.b > t1.b JOIN balls33 t3 ON t3.b > t2.b JOIN balls33 t4 ON t4.b > t3.b JOIN balls33 t5 ON t5.b > t4.b JOIN balls33 t6 ON t6.b > t5.b))"""
_DRAWN6 = ", drawn6 AS (SELECT reds[1]::INT AS b1, reds[2]::INT AS b2, reds[3]::INT AS b3, reds[4]::INT AS b4, reds[5]::INT AS b5, reds[6]::INT AS b6 FROM draws)"
_joint = lambda table, prefix: f"SELECT count(*) FILTER ({_APPLIED}) AS {prefix}fast, count(*) FILTER ({_APPLIED}) AS {prefix}applied, count(*) FILTER ({_APPLIED} AND {_RULES['r7_primes']}) AS {prefix}with_primes FROM {table}"
_CTX = """,
near AS (SELECT step, step - idx AS k, mask AS m FROM steps JOIN draws ON idx < step AND idx >= step - 10),
ctx AS (SELECT step, list(m ORDER BY k) AS ms, max(m) FILTER (k = 1) AS m1, max(m) FILTER (k = 2) AS m2 FROM near GROUP BY step),
cold AS (SELECT step, CAST(coalesce(sum(CASE WHEN omission > 15 THEN 1::BIGINT << CAST(ball AS INT) ELSE 0 END), 0) AS BIGINT) AS cold FROM stats WHERE color = 'red' GROUP BY step)"""
_DYN = {
    "combo_recent_overlap": "len(list_filter(ms, lambda m: bit_count(mask & m) >= 4)) = 0",
    "combo_all_cold": "bit_count(mask & cold) < 6",
    "combo_related": "mask & (m1 | (m1 << 1) | (m1 >> 1)) <> 0",
    "combo_diagonal": "mask & (m1 << 1) & (m2 << 2) = 0",
}
_POOL = f""",
pool AS (SELECT step, CAST(ball AS INT) AS b FROM ranked WHERE color = 'red' AND rn > 16),
chosen AS (SELECT *, {_MASK} AS mask FROM (SELECT t1.step, t1.b AS b1, t2.b AS b2, t3.b AS b3, t4.b AS b4, t5.b AS b5, t6.b AS b6 FROM pool t1 JOIN pool t2 ON t2.step = t1.step AND t2.b > t1.b
  JOIN pool t3 ON t3.step = t1.step AND t3.b > t2.b JOIN pool t4 ON t4.step = t1.step AND t4.b > t3.b JOIN pool t5 ON t5.step = t1.step AND t5.b > t4.b JOIN pool t6 ON t6.step = t1.step AND t6.b > t5.b))"""
_NOT_REJECTED = "(mask * 7919 + 42 * 104729) % 1000003 % 1000 >= 363"
_KEPT = f""",
kept AS (SELECT c.* FROM chosen c JOIN ctx USING (step) JOIN cold USING (step) WHERE {_APPLIED} AND {' AND '.join(_DYN.values())} AND {_NOT_REJECTED})"""
_RULE_TABLE = f"prize_rules(red_hits, blue_hit, prize, tier, tier_rank) AS (VALUES {_LISTS})"
_SETTLED = f""",
{_RULE_TABLE},
bets AS (SELECT k.step, k.mask, r.ball AS blue FROM kept k JOIN ranked r ON r.step = k.step AND r.color = 'blue' AND r.rn = 1),
settled AS (SELECT b.step, bit_count(b.mask & d.mask) AS red_hits, (b.blue = d.blue)::INT AS blue_hit FROM bets b JOIN draws d ON d.idx = b.step),
paid AS (SELECT s.*, coalesce(prize, 0) AS prize, tier, tier_rank FROM settled s LEFT JOIN prize_rules USING (red_hits, blue_hit))"""
_BACK = _DRAWS + _LAST_50 + _SCORE + _CTX + _POOL + _KEPT + _SETTLED
_NOW = _DRAWS + _ONE_STEP + _SCORE
_BETS = """,
singles AS (SELECT k AS bet_id, list_transform([0,1,2,3,4,5], lambda i: (k * 3 + 5 * i) % 33 + 1) AS reds, k * 5 % 16 + 1 AS blue FROM (SELECT range AS k FROM range(10))),
duplex(bet_id, reds, blues) AS (VALUES (1, [5,6,11,14,22,26,32], [1,3,6,10,12,15,16]), (2, [1,5,11,12,14,22,32,33], [2,4]))"""
_COMB = "comb AS (SELECT n, k, CASE WHEN k > n THEN 0 ELSE CAST(round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))) AS BIGINT) END AS ways FROM (SELECT range AS n FROM range(0, 12)), (SELECT range AS k FROM range(0, 7)))"
_SINGLE = f""",
{_RULE_TABLE},
hit AS (SELECT len(list_intersect(s.reds, d.reds)) AS red_hits, (s.blue = d.blue)::INT AS blue_hit FROM draws d CROSS JOIN singles s),
paid AS (SELECT h.*, coalesce(prize, 0) AS prize, coalesce(tier, '未中奖') AS tier, tier_rank FROM hit h LEFT JOIN prize_rules USING (red_hits, blue_hit))"""

_W = "WITH"
_round = lambda c: f"round({c}, 6) AS {c}"
_STATIC = "red_sum red_span odd_count red_zone_small red_zone_medium red_zone_large red_big_count red_prime_count red_sum_tail red_consecutive_groups red_ac_value red_tail_uniques".split()
_LAGS, _MAS = ["blue_lag1", "red_sum_lag1", "odd_count_lag1"], ["red_sum_ma5", "odd_count_ma5", "blue_ma5"]

_REPORT = """
WITH raw AS (SELECT o_orderkey AS k FROM orders),
rep AS (SELECT 'r' || lpad(k::VARCHAR, 9, '0') AS path, k FROM raw)"""



_RANK = "(b1-1) + (b2-1)*(b2-2)//2 + (b3-1)*(b3-2)*(b3-3)//6 + (b4-1)*(b4-2)*(b4-3)*(b4-4)//24 + (b5-1)*(b5-2)*(b5-3)*(b5-4)*(b5-5)//120 + (b6-1)*(b6-2)*(b6-3)*(b6-4)*(b6-5)*(b6-6)//720"


def _places(table: str) -> str:
    """CTEs p8..p0 from a table with rank: the permutation of seed 42 taken back, half-round by half-round; p0 has place."""
    move = lambda x, r, m: f"(({x} + {(42 * 1009 + r * 7919 + 17) % 1000003}) * ({x} * 7919 + 104729 + {(42 * 1009 + r * 7919 + 17) % 1000003}) % 1000003 % {m})"
    out = [f"p8 AS (SELECT *, rank // 1232 AS l, rank % 1232 AS r FROM {table})"]
    for r in range(7, -1, -1):
        own, other, m = ("r", "l", 1232) if r % 2 else ("l", "r", 899)
        out.append(f"p{r} AS (SELECT * REPLACE (({own} + {m} - {move(other, r, m)}) % {m} AS {own}) FROM p{r + 1})")
    return ", ".join(out) + ", placed AS (SELECT *, l * 1232 + r AS place FROM p0)"


def _text_rows(text: str, pieces: dict[str, str]) -> str:
    """(line_no, line) of a text whose marks, @name@, are values that SQL finds."""
    e = "'" + text.replace("'", "''") + "'"
    for name, sql in pieces.items():
        e = f"replace({e}, '@{name}@', ({sql})::VARCHAR)"
    return f"SELECT unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT string_split({e}, chr(10)) AS l)"


_list = lambda balls: f"'[' || array_to_string({balls}, ', ') || ']'"
_balls = lambda mask: f"list_filter(range(1, 34), lambda b: {mask} & (1::BIGINT << CAST(b AS INT)) <> 0)"


def _analysis() -> str:
    """The analysis report from values of the statements above."""
    text = reports.ANALYSIS.replace("{profit:.2f}", "@profit@").format(
        basis="@basis@", target="@target@", now=CLOCK, mode=reports.MODES[True], periods=BACKTEST_STEPS, tiers="@tiers@", picks="@picks@",
        params="\n".join(reports.PARAM_LINE.format(*x) for x in P.shown().items()), wide=reports.WIDE_LINES.format("@best@", "@blues@"),
    )
    now = f"{_W}{_NOW}{_CTX}{_POOL}{_KEPT}"
    return _text_rows(text, {
        "basis": f"{_W}{_DRAWS} SELECT max(issue) FROM draws",
        "target": f"{_W}{_DRAWS} SELECT max(issue) + 1 FROM draws",
        "profit": f"{_W}{_BACK} SELECT printf('%.2f', CAST(sum(prize) - count(*) * 2 AS DOUBLE)) FROM paid",
        "tiers": f"{_W}{_BACK}, won AS (SELECT tier, tier_rank, count(*) AS n FROM paid WHERE prize > 0 GROUP BY ALL) SELECT coalesce(string_agg('  - ' || rpad(tier, 5, ' ') || ': ' || n || ' 次', chr(10) ORDER BY tier_rank), '{reports.NO_TIER}') FROM won",
        "picks": f"""{now}, picked AS (SELECT mask, row_number() OVER (ORDER BY (mask * 31 + 42 * 1009) % 1000033, mask) AS n FROM kept QUALIFY n <= 10)
            SELECT coalesce(string_agg('  组合 ' || printf('%2d', n) || ': 红球 ' || rpad({_list(_balls('mask'))}, 24, ' ') || ' 蓝球 [' || printf('%02d', (SELECT ball FROM ranked WHERE color = 'blue' AND rn = 1)) || ']', chr(10) ORDER BY n), '{reports.NO_PICK}') FROM picked""",
        "best": f"""{now}, sevens AS (SELECT k.mask | (1::BIGINT << p.b) AS m FROM kept k JOIN pool p ON k.mask & (1::BIGINT << p.b) = 0)
            SELECT {_list('balls')} FROM (SELECT {_balls('m')} AS balls, c FROM (SELECT m, count(*) AS c FROM sevens GROUP BY m)) ORDER BY c DESC, balls LIMIT 1""",
        "blues": f"{_W}{_NOW} SELECT '[' || string_agg(ball, ', ' ORDER BY rn) || ']' FROM ranked WHERE color = 'blue' AND rn <= 7",
    })


#: Of each of the last 50 steps, from those and the 50 before them: picks, blues, the set of seven, and the backtest of the 50 steps before it.
_STEPS_100 = ",\nsteps AS (SELECT idx AS step FROM draws WHERE idx >= (SELECT count(*) FROM draws) - 100)"
_REPORTS = f"""{_W}{_DRAWS}{_STEPS_100}{_SCORE}{_CTX}{_POOL}{_KEPT}{_SETTLED}, {_COMB},
shown AS (SELECT step FROM steps WHERE step >= (SELECT count(*) FROM draws) - 50),
back AS (SELECT s.step, sum(p.prize) - 2 * count(*) AS profit FROM shown s JOIN paid p ON p.step BETWEEN s.step - 50 AND s.step - 1 GROUP BY s.step),
won AS (SELECT s.step, tier, tier_rank, count(*) AS n FROM shown s JOIN paid p ON p.step BETWEEN s.step - 50 AND s.step - 1 WHERE prize > 0 GROUP BY ALL),
tier_lines AS (SELECT step, string_agg('  - ' || rpad(tier, 5, ' ') || ': ' || n || ' 次', chr(10) ORDER BY tier_rank) AS tiers FROM won GROUP BY step),
numbered AS (SELECT step, mask, row_number() OVER (PARTITION BY step ORDER BY (mask * 31 + 42 * 1009) % 1000033, mask) AS n FROM kept JOIN shown USING (step) QUALIFY n <= 10),
first_blue AS (SELECT step, ball FROM ranked WHERE color = 'blue' AND rn = 1),
pick_lines AS (SELECT step, string_agg('  组合 ' || printf('%2d', n) || ': 红球 ' || rpad({_list(_balls('mask'))}, 24, ' ') || ' 蓝球 [' || printf('%02d', ball) || ']', chr(10) ORDER BY n) AS picks FROM numbered JOIN first_blue USING (step) GROUP BY step),
blues AS (SELECT step, list(ball ORDER BY rn) AS blues FROM ranked WHERE color = 'blue' AND rn <= 7 GROUP BY step),
sevens AS (SELECT k.step, k.mask | (1::BIGINT << p.b) AS m FROM kept k JOIN shown USING (step) JOIN pool p ON p.step = k.step AND k.mask & (1::BIGINT << p.b) = 0),
best AS (SELECT step, m, balls FROM (SELECT step, m, c, {_balls('m')} AS balls FROM (SELECT step, m, count(*) AS c FROM sevens GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY step ORDER BY c DESC, balls) = 1)"""


def _report_files() -> str:
    text = reports.ANALYSIS.replace("{profit:.2f}", "@profit@").format(
        basis="@basis@", target="@target@", now=CLOCK, mode=reports.MODES[True], periods=BACKTEST_STEPS, tiers="@tiers@", picks="@picks@",
        params="\n".join(reports.PARAM_LINE.format(*x) for x in P.shown().items()), wide="@wide@",
    )
    e = "'" + text.replace("'", "''") + "'"
    for name, sql in {
        "basis": "basis", "target": "basis + 1", "profit": "printf('%.2f', profit::DOUBLE)", "tiers": f"coalesce(tiers, '{reports.NO_TIER}')", "picks": f"coalesce(picks, '{reports.NO_PICK}')",
        "wide": f"coalesce('  红球: ' || {_list('balls')} || chr(10) || '  蓝球: ' || {_list('blues')}, '{reports.NO_WIDE}')",
    }.items():
        e = f"replace({e}, '@{name}@', ({sql})::VARCHAR)"
    return f"""{_REPORTS}, texts AS (SELECT basis::VARCHAR AS basis, string_split({e}, chr(10)) AS l FROM (SELECT step, (SELECT issue FROM draws WHERE idx = step - 1) AS basis FROM shown)
        LEFT JOIN back USING (step) LEFT JOIN tier_lines USING (step) LEFT JOIN pick_lines USING (step) LEFT JOIN blues USING (step) LEFT JOIN best USING (step))
        SELECT basis, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM texts"""


_REPORTS_SETTLED = f"""{_REPORTS},
singles AS (SELECT d.issue::VARCHAR AS issue, 'single' AS kind, coalesce(tier, '{NO_PRIZE}') AS tier, 1 AS ways, coalesce(prize, 0) AS prize
  FROM (SELECT n.step, bit_count(n.mask & d.mask) AS red_hits, (b.ball = d.blue)::INT AS blue_hit FROM numbered n JOIN first_blue b USING (step) JOIN draws d ON d.idx = n.step) x JOIN draws d ON d.idx = x.step LEFT JOIN prize_rules USING (red_hits, blue_hit)),
wide AS (SELECT d.issue::VARCHAR AS issue, bit_count(m & d.mask) AS red_hits, list_contains(blues, d.blue)::INT AS blue_hits FROM best JOIN blues USING (step) JOIN draws d ON d.idx = step),
ways AS (SELECT issue, 'duplex' AS kind, r.tier, a.ways * b.ways AS ways, a.ways * b.ways * r.prize AS prize FROM wide h JOIN prize_rules r ON r.red_hits <= h.red_hits AND r.blue_hit = h.blue_hits
  JOIN comb a ON a.n = h.red_hits AND a.k = r.red_hits JOIN comb b ON b.n = 7 - h.red_hits AND b.k = 6 - r.red_hits)
SELECT issue, kind, tier, CAST(sum(ways) AS BIGINT) AS ways, CAST(sum(prize) AS BIGINT) AS prize FROM (SELECT * FROM singles UNION ALL SELECT * FROM ways) GROUP BY ALL"""


def _settlement() -> str:
    """The settlement report of the latest draw and the fixed bets."""
    names = "now name issue reds blue singles first wide_reds wide_blues red_hits blue_hits tiers second total".split()
    text = reports.SETTLEMENT.format(**{n: f"@{n}@" for n in names} | {"now": CLOCK, "name": "report.txt"})
    drawn = f"{_W}{_DRAWS}{_BETS}, {_RULE_TABLE}, {_COMB}, won AS (SELECT * FROM draws ORDER BY issue DESC LIMIT 1)"
    one = f"""{drawn}, hit AS (SELECT bet_id, s.reds, s.blue, len(list_intersect(s.reds, w.reds)) AS red_hits, (s.blue = w.blue)::INT AS blue_hit FROM singles s CROSS JOIN won w),
        paid AS (SELECT h.*, coalesce(prize, 0) AS prize, coalesce(tier, '{NO_PRIZE}') AS tier FROM hit h LEFT JOIN prize_rules USING (red_hits, blue_hit))"""
    many = f"""{drawn}, hit AS (SELECT x.reds, x.blues, len(list_intersect(x.reds, w.reds)) AS red_hits, list_contains(x.blues, w.blue)::INT AS blue_hits FROM duplex x CROSS JOIN won w WHERE bet_id = 1),
        ways AS (SELECT r.tier, r.tier_rank, sum(a.ways * b.ways)::BIGINT AS ways, sum(a.ways * b.ways * r.prize)::BIGINT AS prize FROM hit h JOIN prize_rules r ON r.red_hits <= h.red_hits AND r.blue_hit = h.blue_hits
          JOIN comb a ON a.n = h.red_hits AND a.k = r.red_hits JOIN comb b ON b.n = len(h.reds) - h.red_hits AND b.k = 6 - r.red_hits GROUP BY ALL)"""
    first, second = f"{one} SELECT sum(prize)::BIGINT FROM paid", f"{many} SELECT coalesce(sum(prize), 0)::BIGINT FROM ways"
    return _text_rows(text, {
        "issue": f"{drawn} SELECT issue FROM won", "reds": f"{drawn} SELECT {_list('reds')} FROM won", "blue": f"{drawn} SELECT blue FROM won",
        "singles": f"""{one} SELECT string_agg('  组合 ' || printf('%2d', bet_id + 1) || ': ' || rpad({_list('list_sort(reds)')}, 24, ' ') || ' 蓝球 [' || printf('%02d', blue) || '] -> 命中' || red_hits || '+' || blue_hit || ', ' || tier || ', 奖金: ' || prize || ' 元', chr(10) ORDER BY bet_id) FROM paid""",
        "first": first, "second": second, "total": f"SELECT ({first}) + ({second})",
        "wide_reds": f"{many} SELECT {_list('reds')} FROM hit", "wide_blues": f"{many} SELECT {_list('blues')} FROM hit", "red_hits": f"{many} SELECT red_hits FROM hit", "blue_hits": f"{many} SELECT blue_hits FROM hit",
        "tiers": f"{many} SELECT coalesce(string_agg(chr(10) || '    - ' || tier || ': ' || ways || ' 注', '' ORDER BY tier_rank), '{reports.NONE_WON}') FROM ways",
    })


def _rule_verdicts() -> str:
    tests = _RULES | {
        "r9_recent_overlap": "len(list_filter(ms, lambda m: bit_count(mask & m) >= 4)) = 0", "r10_all_cold": "bit_count(mask & cold) < 6",
        "r16_related": "mask & (m1 | (m1 << 1) | (m1 >> 1)) <> 0", "r17_diagonal": "mask & (m1 << 1) & (m2 << 2) = 0",
    }
    return f"""{_W}{_DRAWS}, gone AS (
          SELECT d.idx, b.ball, d.idx - coalesce(max(CASE WHEN list_contains(d.reds, b.ball) THEN d.idx END) OVER (PARTITION BY b.ball ORDER BY d.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS omission FROM draws d CROSS JOIN nums b),
        cold AS (SELECT idx, CAST(coalesce(sum(1::BIGINT << CAST(ball AS INT)) FILTER (omission > 15), 0) AS BIGINT) AS cold FROM gone GROUP BY idx),
        seen AS (SELECT idx, mask, reds[1]::INT AS b1, reds[2]::INT AS b2, reds[3]::INT AS b3, reds[4]::INT AS b4, reds[5]::INT AS b5, reds[6]::INT AS b6, lag(mask) OVER (ORDER BY idx) AS m1, lag(mask, 2) OVER (ORDER BY idx) AS m2,
          list(mask) OVER (ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ms FROM draws),
        said AS (SELECT unnest([{', '.join(f"'{k}'" for k in tests)}]) AS rule, unnest([{', '.join(f'({v})::INT' for v in tests.values())}]) AS kept, {' + '.join(f'(1 - ({v})::INT)' for v in tests.values())} AS n_bad FROM seen JOIN cold USING (idx) WHERE idx >= 10)
        SELECT rule, count(*) AS draws, CAST(sum(1 - kept) AS BIGINT) AS broken, count(*) FILTER (kept = 0 AND n_bad = 1) AS alone FROM said GROUP BY rule"""


def oracle_sql() -> dict[str, str]:
    out = {
        "analysis_report_lines": _analysis(),
        "settlement_report_lines": _settlement(),
        "report_files_lines": _report_files(),
        "report_files_settled": _REPORTS_SETTLED,
        "draws_wide": f"{_W}{_DRAWS} SELECT issue, idx, reds[1] AS b1, reds[2] AS b2, reds[3] AS b3, reds[4] AS b4, reds[5] AS b5, reds[6] AS b6, blue, mask FROM draws",
        "draw_features_static": f"{_W}{_DRAWS}{_FEAT} SELECT issue, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _STATIC)} FROM feats",
        "draw_features_window": f"{_W}{_DRAWS}{_FEAT}{_WINDOWED} SELECT issue, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _LAGS)}, {', '.join(map(_round, _MAS))} FROM windowed",
        "ball_decayed_freq": f"{_W}{_NOW} SELECT ball, round(freq, 6) AS freq FROM stats WHERE color = 'red'",
        "blue_decayed_freq": f"{_W}{_NOW} SELECT ball, round(freq, 6) AS freq FROM stats WHERE color = 'blue'",
        "ball_omission": f"{_W}{_NOW} SELECT color, ball, omission FROM stats",
        "ball_stats_every_step": f"""{_W}{_DRAWS}, drawn AS (SELECT idx, 'red' AS color, unnest(reds) AS ball FROM draws UNION ALL SELECT idx, 'blue', blue FROM draws),
            every AS (SELECT step, color, ball FROM (SELECT unnest(range(0, (SELECT count(*) + 1 FROM draws))) AS step) CROSS JOIN (SELECT 'red' AS color, range AS ball FROM range(1, 34) UNION ALL SELECT 'blue', range FROM range(1, 17)))
            SELECT step, color, ball, round(coalesce(sum(pow({P.decay_factor}, -idx)) OVER w, 0) * pow({P.decay_factor}, step - 1), 6) AS freq, step - coalesce(max(idx) OVER w, -1) - 1 AS omission
            FROM every LEFT JOIN (SELECT idx + 1 AS step, color, ball, idx FROM drawn) USING (step, color, ball) WINDOW w AS (PARTITION BY color, ball ORDER BY step)""",
        "ball_split_gains": f"""{_W}{_DRAWS}{_FEAT}{_WINDOWED},
            known AS (SELECT f.idx, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _STATIC + _LAGS + _MAS)} FROM feats f JOIN windowed w USING (idx) WHERE f.idx >= 5 AND f.idx < (SELECT count(*) - 1 FROM draws)),
            long AS (UNPIVOT known ON COLUMNS(* EXCLUDE idx) INTO NAME feature VALUE x),
            cuts AS (SELECT DISTINCT feature, unnest(c) AS cut FROM (SELECT feature, quantile_disc(x, [{', '.join(f'{i}/16' for i in range(1, 16))}]) AS c FROM long GROUP BY feature)),
            n_left AS (SELECT feature, cut, count(*) AS n_left FROM long JOIN cuts USING (feature) WHERE x <= cut GROUP BY ALL),
            ahead AS (SELECT idx - 1 AS idx, 'red' AS color, unnest(reds) AS ball FROM draws UNION ALL SELECT idx - 1, 'blue', blue FROM draws),
            total AS (SELECT count(*) AS n FROM known),
            base AS (SELECT color, ball, count(*) AS hits, count(*) / (SELECT n FROM total) AS p FROM ahead JOIN known USING (idx) GROUP BY ALL),
            hit_left AS (SELECT feature, cut, color, ball, count(*) AS hits_left FROM long JOIN ahead USING (idx) JOIN cuts USING (feature) WHERE x <= cut GROUP BY ALL),
            sides AS (SELECT feature, cut, n_left, n, p * (1 - p) AS h, n_left * p - coalesce(hits_left, 0) AS g FROM n_left CROSS JOIN base CROSS JOIN total LEFT JOIN hit_left USING (feature, cut, color, ball))
            SELECT feature, round(cut, 6) AS cut, n_left, round(sum(g * g / (n_left * h + 1) + g * g / ((n - n_left) * h + 1)) / 2, 6) AS gain FROM sides WHERE n_left >= 20 AND n - n_left >= 20 GROUP BY feature, cut, n_left""",
        "ball_score_rank": f"{_W}{_NOW} SELECT color, ball, round(score, 6) AS score, rn FROM ranked",
        "contrarian_pool": f"{_W}{_NOW} SELECT ball, rn FROM ranked WHERE color = 'red' AND rn > 16",
        "top_blue": f"{_W}{_NOW} SELECT ball, rn FROM ranked WHERE color = 'blue' AND rn <= 7",
        "next_draw_labels": f"{_W}{_DRAWS} SELECT issue, lead(mask) OVER (ORDER BY idx) AS next_mask, lead(blue) OVER (ORDER BY idx) AS next_blue FROM draws",
        "feature_mean_fill": f"{_W}{_DRAWS}{_FEAT}{_WINDOWED} SELECT issue, {', '.join(f'round({c}, 6) AS {c}' for c in _LAGS + _MAS)} FROM (SELECT issue, idx, {', '.join(f'coalesce({c}, avg({c}) OVER ()) AS {c}' for c in _LAGS + _MAS)} FROM windowed)",
        "csv_history_gbk": f"{_W}{_DRAWS} SELECT issue, strftime(draw_date, '%Y-%m-%d') AS draw_date, array_to_string(reds, ',') AS reds, blue FROM draws",
        "events_json": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
        "pool_from_params_file": f"{_W}{_NOW} SELECT ball, rn FROM ranked WHERE color = 'red' AND rn > 16",
        "ball_bayes_probs": _with_bayes(f"{_W}{_DRAWS}{_LAST_50}{_SCORE} SELECT step, color, ball, round(prob, 6) AS prob FROM normed"),
        "backtest_bayes": _with_bayes(f"{_W}{_BACK} SELECT step, count(*) AS bets, CAST(sum(prize) AS BIGINT) AS prize FROM paid GROUP BY step"),
        "settle_duplex_all_blues": f"""{_W}{_DRAWS}{_BETS}, {_RULE_TABLE}, {_COMB},
            hit AS (SELECT d.issue, x.bet_id, len(list_intersect(x.reds, d.reds)) AS red_hits, len(x.reds) AS n, list_contains(x.blues, d.blue)::INT AS blue_hits, len(x.blues) AS n_blues FROM draws d CROSS JOIN duplex x),
            ways AS (SELECT h.bet_id, r.tier, a.ways * b.ways * CASE WHEN r.blue_hit = 1 THEN blue_hits ELSE n_blues - blue_hits END AS ways, r.prize FROM hit h JOIN prize_rules r ON r.red_hits <= h.red_hits AND (r.blue_hit = h.blue_hits OR r.blue_hit = 0)
              JOIN comb a ON a.n = h.red_hits AND a.k = r.red_hits JOIN comb b ON b.n = h.n - h.red_hits AND b.k = 6 - r.red_hits)
            SELECT bet_id::BIGINT AS bet_id, tier, CAST(sum(ways) AS BIGINT) AS ways, CAST(sum(ways * prize) AS BIGINT) AS prize FROM ways GROUP BY bet_id, tier""",
        "csv_history": f"{_W}{_DRAWS} SELECT issue, strftime(draw_date, '%Y-%m-%d') AS draw_date, array_to_string(reds, ',') AS reds, blue FROM draws",
        "candidate_list": f"""{_W}{_NOW}{_CTX}{_POOL}{_KEPT}, numbered AS (SELECT *, row_number() OVER (ORDER BY b1, b2, b3, b4, b5, b6) AS line_no, count(*) OVER () AS n FROM kept)
            SELECT line_no, '  组合 ' || CASE WHEN n < 100 THEN printf('%2d', line_no) ELSE printf('%3d', line_no) END || ': ' || printf('%02d %02d %02d %02d %02d %02d', b1, b2, b3, b4, b5, b6) AS line FROM numbered""",
        "settle_from_files": f"""{_W}{_DRAWS}{_BEFORE_LAST}{_SCORE}{_CTX}{_POOL}{_KEPT}, {_RULE_TABLE}, {_COMB},
            won AS (SELECT mask, blue FROM draws WHERE idx = (SELECT step FROM steps)),
            picked AS (SELECT mask, row_number() OVER (ORDER BY (mask * 31 + 42 * 1009) % 1000033, mask) AS bet FROM kept QUALIFY bet <= 10),
            blues AS (SELECT ball, rn FROM ranked WHERE color = 'blue' AND rn <= 7),
            hit AS (SELECT bet, p.mask, bit_count(p.mask & w.mask) AS red_hits, (SELECT (b.ball = w.blue)::INT FROM blues b WHERE rn = 1) AS blue_hit FROM picked p CROSS JOIN won w),
            sevens AS (SELECT k.mask | (1::BIGINT << p.b) AS m FROM kept k JOIN pool p ON k.mask & (1::BIGINT << p.b) = 0),
            best AS (SELECT m, list_filter(range(1, 34), lambda b: m & (1::BIGINT << CAST(b AS INT)) <> 0) AS balls FROM (SELECT m, count(*) AS c FROM sevens GROUP BY m) ORDER BY c DESC, balls LIMIT 1),
            wide AS (SELECT balls, bit_count(m & w.mask) AS red_hits, (w.blue IN (SELECT ball FROM blues))::INT AS blue_hits FROM best CROSS JOIN won w),
            ways AS (SELECT balls, h.red_hits, h.blue_hits, r.tier, sum(a.ways * b.ways) AS ways, sum(a.ways * b.ways * r.prize) AS prize FROM wide h JOIN prize_rules r ON r.red_hits <= h.red_hits AND r.blue_hit = h.blue_hits
              JOIN comb a ON a.n = h.red_hits AND a.k = r.red_hits JOIN comb b ON b.n = 7 - h.red_hits AND b.k = 6 - r.red_hits GROUP BY ALL)
            SELECT 'single' AS kind, bet, array_to_string(list_filter(range(1, 34), lambda b: mask & (1::BIGINT << CAST(b AS INT)) <> 0), ',') AS reds, red_hits::BIGINT AS red_hits, blue_hit::BIGINT AS blue_hits, coalesce(tier, '未中奖') AS tier, 1::BIGINT AS ways, coalesce(prize, 0)::BIGINT AS prize
            FROM hit LEFT JOIN prize_rules USING (red_hits, blue_hit)
            UNION ALL SELECT 'duplex', 1, array_to_string(balls, ','), red_hits::BIGINT, blue_hits::BIGINT, tier, ways::BIGINT, prize::BIGINT FROM ways""",
        "combo_rule_counts": f"{_W}{_DRAWS}{_DRAWN6}, {_ALL}, " + "every AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS kept FROM combos" for k, v in _RULES.items()) + "), of_draws AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS draws_kept FROM drawn6" for k, v in _RULES.items()) + ") SELECT * FROM every JOIN of_draws USING (rule)",
        "draw_rule_verdicts": _rule_verdicts(),
        "combo_rules_joint": f"{_W}{_DRAWS}{_DRAWN6}, {_ALL} SELECT * FROM (" + _joint("combos", "") + ") CROSS JOIN (" + _joint("drawn6", "draws_") + ")",
        "pool_combinations_kept": f"{_W}{_NOW}{_POOL} SELECT mask FROM chosen WHERE {_APPLIED}",
        "draw_overlaps": f"""{_W}{_DRAWS} SELECT a.issue, count(b.idx) AS n_earlier, max(b.idx) AS last_idx FROM draws a LEFT JOIN draws b ON b.idx < a.idx AND bit_count(a.mask & b.mask) >= 4 GROUP BY a.issue""",
        "unseen_pairs_of_four": f"{_W}{_NOW}{_POOL} SELECT c.mask FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM draws d WHERE idx >= (SELECT count(*) - 200 FROM draws) AND bit_count(c.mask & d.mask) >= 4)",
        "draw_ranks": f"""{_W}{_DRAWS}, b AS (SELECT issue, mask, reds[1]::BIGINT AS b1, reds[2]::BIGINT AS b2, reds[3]::BIGINT AS b3, reds[4]::BIGINT AS b4, reds[5]::BIGINT AS b5, reds[6]::BIGINT AS b6 FROM draws),
            ranks AS (SELECT issue, mask, {_RANK} AS rank FROM b), {_places("ranks")} SELECT issue, rank, place, rank AS rank_back, mask, place < round(1107568 * (1 - pow(1 - 1 / 1107568, 500000))) AS rejected FROM placed""",
        "sampled_combinations": f"""{_W} {_ALL}, ranks AS (SELECT mask, row_number() OVER (ORDER BY b6, b5, b4, b3, b2, b1) - 1 AS rank FROM combos), {_places("ranks")} SELECT place, mask FROM placed WHERE place < (SELECT count(*) FROM orders)""",
        "rejection_anti": f"{_W}{_NOW}{_POOL} SELECT mask FROM chosen WHERE {_NOT_REJECTED}",
        "coverage_semi": f"{_W}{_NOW}{_CTX}{_POOL}{_KEPT} SELECT mask FROM chosen WHERE mask IN (SELECT mask FROM kept)",
        "coverage7_top": f"""{_W}{_NOW}{_CTX}{_POOL}{_KEPT}, sevens AS (SELECT k.mask | (1::BIGINT << p.b) AS m FROM kept k JOIN pool p ON k.mask & (1::BIGINT << p.b) = 0),
            cov AS (SELECT m, count(*) AS coverage FROM sevens GROUP BY m),
            listed AS (SELECT list_filter(range(1, 34), lambda b: m & (1::BIGINT << CAST(b AS INT)) <> 0) AS balls, coverage FROM cov)
            SELECT array_to_string(balls, ',') AS reds, coverage FROM listed ORDER BY coverage DESC, balls LIMIT 1""",
        "seeded_pick": f"{_W}{_NOW}{_CTX}{_POOL}{_KEPT} SELECT mask, (mask * 31 + 42 * 1009) % 1000033 AS pick_key FROM kept ORDER BY pick_key, mask LIMIT 10",
        "settle_single": f"{_W}{_DRAWS}{_BETS}{_SINGLE} SELECT '命中' || red_hits || '+' || blue_hit AS hit_text, tier, count(*) AS n, CAST(sum(prize) AS BIGINT) AS prize FROM paid GROUP BY ALL",
        "tier_rollup": f"{_W}{_DRAWS}{_BETS}{_SINGLE} SELECT tier, CAST(tier_rank AS BIGINT) AS tier_rank, count(*) AS n FROM paid WHERE prize > 0 GROUP BY ALL",
        "settle_duplex": f"""{_W}{_DRAWS}{_BETS}, {_RULE_TABLE}, {_COMB},
            hit AS (SELECT d.issue, x.bet_id, len(list_intersect(x.reds, d.reds)) AS red_hits, len(x.reds) AS n, list_contains(x.blues, d.blue)::INT AS blue_hits FROM draws d CROSS JOIN duplex x),
            ways AS (SELECT h.issue, h.bet_id, h.red_hits, h.blue_hits, r.tier, sum(a.ways * b.ways) AS ways, sum(a.ways * b.ways * r.prize) AS prize FROM hit h JOIN prize_rules r ON r.red_hits <= h.red_hits AND r.blue_hit = h.blue_hits
              JOIN comb a ON a.n = h.red_hits AND a.k = r.red_hits JOIN comb b ON b.n = h.n - h.red_hits AND b.k = 6 - r.red_hits GROUP BY ALL)
            SELECT CAST(bet_id AS BIGINT) AS bet_id, red_hits, CAST(blue_hits AS BIGINT) AS blue_hits, tier, count(*) AS draws, CAST(sum(ways) AS BIGINT) AS ways, CAST(sum(prize) AS BIGINT) AS prize FROM ways GROUP BY ALL""",
        "backtest_pnl": f"{_W}{_BACK} SELECT count(*) AS bets, count(*) * 2 AS cost, CAST(sum(prize) AS BIGINT) AS winnings, CAST(sum(prize) - count(*) * 2 AS BIGINT) AS profit FROM paid",
        "backtest_prize_counts": f"{_W}{_BACK} SELECT red_hits::BIGINT AS red_hits, blue_hit::BIGINT AS blue_hit, count(*) AS n FROM paid WHERE prize > 0 GROUP BY ALL",
        "backtest_by_step": f"{_W}{_BACK} SELECT step, count(*) AS bets, CAST(sum(prize) AS BIGINT) AS prize FROM paid GROUP BY step",
        "upsert_keep_last": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
        "ingest_store": f"""{_W}{_DRAWS}, kinds AS (SELECT d.*, o_orderpriority IN ('1-URGENT', '2-HIGH') AS line, o_orderstatus = 'F' AS page FROM draws d JOIN orders ON o_orderkey = issue)
            SELECT issue::VARCHAR AS issue, CASE WHEN line THEN strftime(draw_date, '%Y-%m-%d') WHEN page THEN NULL ELSE '2000-01-01' END AS draw_date, array_to_string(list_transform(reds, lambda b: lpad(b::VARCHAR, 2, '0')), ',') AS reds,
                   CASE WHEN line OR page THEN lpad(blue::VARCHAR, 2, '0') ELSE '00' END AS blue, 2::BIGINT AS version FROM kinds""",
        "precedence_union": "SELECT o_orderkey::VARCHAR AS issue, CASE WHEN o_orderpriority = '1-URGENT' THEN 'text' WHEN o_orderstatus = 'F' THEN 'html' ELSE o_orderstatus END AS val, CASE WHEN o_orderpriority = '1-URGENT' THEN '2021-01-01' WHEN o_orderstatus = 'F' THEN NULL ELSE '2020-01-01' END AS draw_date FROM orders",
        "text_line_parse": f"""{_W}{_DRAWS}, good AS (SELECT issue::VARCHAR AS issue, strftime(draw_date, '%Y-%m-%d') AS draw_date, array_to_string(reds, ',') AS reds, blue::VARCHAR AS blue FROM draws WHERE issue % 7 <> 0 AND issue % 11 <> 0 AND issue % 13 <> 0),
            prose AS (SELECT regexp_split_to_array(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s+') AS f FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
            SELECT * FROM good UNION ALL SELECT f[1], f[2], array_to_string(f[3:8], ','), f[9] FROM prose WHERE len(f) >= 9 AND regexp_full_match(f[1], '[0-9]+') AND len(string_split(f[2], '-')) = 3""",
        "html_table_extract": """SELECT page_id, page_id::VARCHAR AS issue, array_to_string(list_transform([0,1,2,3,4,5], lambda i: lpad(((page_id * (i + 3)) % 30 + 1)::VARCHAR, 2, '0')), ',') AS reds, lpad((page_id % 18)::VARCHAR, 2, '0') AS blue FROM pages WHERE page_id % 18 BETWEEN 1 AND 16""",
        "page_blocks": r"""WITH shown AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS h FROM pages),
            cut AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(?i)</?(html|head|title|body|nav|ul|li|div|article|h1|p|br|footer)(\s[^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS l FROM shown),
            said AS (SELECT page_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM cut)
            SELECT page_id, len(b) AS n_blocks, length(array_to_string(b, '')) AS n_chars, list_max(list_transform(b, lambda x: length(x))) AS longest, sha256(array_to_string(b, chr(10))) AS blocks_sha256 FROM said""",
        "report_parse_bets": f"""{_REPORT} SELECT path, 'single' AS kind, array_to_string(list_transform([1,2,3,4,5,6], lambda i: (k + i * 5) % 33 + 1), ',') AS reds, (k % 9 + 1)::VARCHAR AS blues FROM rep
            UNION ALL SELECT path, 'duplex', array_to_string(list_transform([1,2,3,4,5,6,7], lambda i: (k + i * 4) % 33 + 1), ','), array_to_string(list_transform([1,2,3], lambda i: (k + i * 2) % 33 + 1), ',') FROM rep""",
        "report_match": f"{_REPORT} SELECT path, '42' AS target FROM rep WHERE k % 100 = 42 ORDER BY path DESC LIMIT 1",
        "next_issue": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'S' || o_orderkey || '_Next' ELSE (o_orderkey + 1)::VARCHAR END AS next_issue FROM orders",
        "events_lag_ma5": "SELECT event_id, round(lag(value) OVER o, 6) AS lag1, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 6) AS ma5 FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id), w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)",
        "event_type_decayed_freq": "SELECT event_type, round(sum(pow(0.999, n - 1 - idx)), 6) AS freq FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS idx, count(*) OVER () AS n FROM events) GROUP BY event_type",
        "user_omission": "SELECT user_id, max(n) - 1 - max(idx) AS omission FROM (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS idx, count(*) OVER () AS n FROM events) GROUP BY user_id",
        "part_score_skip_topk": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part QUALIFY rn > 16",
        "tiered_lookup_join": f"WITH {_RULE_TABLE} SELECT coalesce(tier, '未中奖') AS tier, count(*) AS n, CAST(sum(coalesce(prize, 0)) AS BIGINT) AS prize FROM lineitem LEFT JOIN prize_rules ON red_hits = l_linenumber % 7 AND blue_hit = CAST(l_quantity AS BIGINT) % 2 GROUP BY 1",
    }
    for name, keep in _DYN.items():
        out[name] = f"{_W}{_NOW}{_CTX}, {_ALL} SELECT b1::BIGINT AS b1, count(*) FILTER ({keep}) AS kept FROM combos CROSS JOIN ctx CROSS JOIN cold GROUP BY b1"
    return out
