"""Queries over conversation turns."""

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from .base import big, query, r

BUDGET = 1500            # small enough that some turns do not fit and are passed over

CASES = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{c}' END" for c, ws in rt.CONCEPTS.items())


def terms_sql(src, key):
    return f"""(SELECT {key}, unnest(list_concat(flatten(list_transform(regexp_extract_all(lower(text), '([一-鿿]+|[A-Za-z0-9_-]+)'), lambda w: CASE WHEN ord(w[1]) < 128 OR length(w) = 1 THEN [w] ELSE list_transform(generate_series(1, length(w) - 1), lambda j: substr(w, j, 2)) END)), list_filter([{CASES}], lambda x: x IS NOT NULL))) AS term FROM {src})"""


# Turns of every conversation; the queries are the user messages of the last turn of each conversation.
TURN_SQL = """cv AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN text || ' 导出 chart run_7' WHEN conv_id % 3 = 1 THEN text || ' 同期 图表 lead-lag' ELSE text END AS text FROM conversations),
nm AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM cv),
tu AS (SELECT conv_id, turn_no, min(turn) AS first_turn, count(*) AS messages, string_agg(text, chr(10) ORDER BY turn) AS text, conv_id || ':' || turn_no AS turn_id FROM nm GROUP BY 1, 2),
qs AS (SELECT conv_id AS query_id, conv_id, arg_max(text, turn) AS text FROM cv WHERE role = 'user' GROUP BY 1, 2)"""


def conversations(t):
    k = F.col("conv_id") % 3
    text = F.when(k == 0, F.concat(F.col("text"), F.lit(" 导出 chart run_7"))).when(k == 1, F.concat(F.col("text"), F.lit(" 同期 图表 lead-lag"))).otherwise(F.col("text"))
    return t.read("conversations").withColumn("text", text)


def turns(t):
    return t.once("turns", lambda: rt.group_turns(conversations(t)))


def queries(t):
    return t.once("queries", lambda: conversations(t).where(F.col("role") == "user").groupBy(F.col("conv_id").alias("query_id"), "conv_id").agg(F.max_by("text", "turn").alias("text")))


@query("tokenize", f"WITH {TURN_SQL} SELECT conv_id, turn, {big('count(term)')} AS terms, {big('count(DISTINCT term)')} AS distinct_terms, min(term) AS first_term FROM {terms_sql('cv', 'conv_id, turn')} GROUP BY 1, 2")
def _(t):
    e = rt.tokenize(conversations(t)).select("conv_id", "turn", F.explode("terms").alias("term"))
    return e.groupBy("conv_id", "turn").agg(F.count("term").alias("terms"), F.countDistinct("term").alias("distinct_terms"), F.min("term").alias("first_term"))


@query("group_turns", f"WITH {TURN_SQL} SELECT conv_id, turn_no, first_turn, messages, md5(text) AS text_md5, turn_id FROM tu")
def _(t):
    return turns(t).select("conv_id", "turn_no", "first_turn", "messages", F.md5("text").alias("text_md5"), "turn_id")


MATCH_SQL = TURN_SQL.replace("tu AS (", "al AS (") + f""",
rc AS (SELECT conv_id || ':' || max(turn_no) AS turn_id FROM al GROUP BY conv_id), tu AS (SELECT * FROM al ANTI JOIN rc USING (turn_id)),
ix AS (SELECT turn_id, term, count(*) AS tf FROM {terms_sql('tu', 'turn_id')} GROUP BY 1, 2), ln AS (SELECT tu.turn_id, coalesce(n, 0) AS length FROM tu LEFT JOIN (SELECT turn_id, sum(tf) AS n FROM ix GROUP BY 1) USING (turn_id)),
tot AS (SELECT conv_id, count(*) AS docs, avg(length) AS av FROM ln JOIN tu USING (turn_id) GROUP BY 1), dc AS (SELECT conv_id, term, count(*) AS df FROM ix JOIN tu USING (turn_id) GROUP BY 1, 2), qt AS (SELECT DISTINCT query_id, conv_id, term FROM {terms_sql('qs', 'query_id, conv_id')}),
ma AS (SELECT query_id, ix.turn_id, tu.conv_id, ix.term, ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / av)) AS part, df, docs FROM qt JOIN tu ON tu.conv_id = qt.conv_id JOIN ix ON ix.turn_id = tu.turn_id AND ix.term = qt.term JOIN dc ON dc.conv_id = qt.conv_id AND dc.term = qt.term JOIN ln ON ln.turn_id = ix.turn_id JOIN tot ON tot.conv_id = qt.conv_id),
qn AS (SELECT query_id, count(*) AS q, count_if(starts_with(term, '@concept.')) AS qc FROM qt GROUP BY 1),
g0 AS (SELECT query_id, turn_id, conv_id, sum(part) AS score, count(*) AS matched, count_if(starts_with(term, '@concept.')) AS c, max(CASE WHEN NOT starts_with(term, '@concept.') AND ord(term[1]) < 128 AND regexp_matches(term, '[-_0-9]') THEN 1 ELSE 0 END) AS ident, count_if(NOT (docs >= 4 AND df / docs > 0.65)) AS rare FROM ma GROUP BY 1, 2, 3),
ga AS (SELECT query_id, turn_id, conv_id, {r('score')} AS score, matched AS matched_terms, {r('CASE WHEN c >= 2 AND c / qc >= 0.5 THEN c / qc WHEN ident = 1 THEN 1.0 ELSE matched / q END')} AS coverage,
 (c >= 2 AND c / qc >= 0.5) OR ident = 1 OR (matched >= CASE WHEN q <= 2 THEN 1 ELSE 2 END AND matched / q >= 0.25 AND NOT (rare = 0 AND (q <= 2 OR matched / q < 0.75))) AS relevant FROM g0 JOIN qn USING (query_id))"""


def corpus(t):
    """Turns of each conversation but its last, which is in view."""
    last = turns(t).groupBy("conv_id").agg(F.max_by("turn_id", "turn_no").alias("turn_id"))
    return t.once("corpus", lambda: rt.without_recent(turns(t), last))


def matches(t):
    return t.once("matches", lambda: rt.bm25_matches(corpus(t), queries(t), t.keep))


@query("bm25", f"WITH {MATCH_SQL} SELECT query_id, turn_id, {r('sum(part)')} AS score, count(*) AS matched_terms FROM ma GROUP BY 1, 2")
def _(t):
    return rt.bm25(matches(t))


@query("relevance_gate", f"WITH {MATCH_SQL} SELECT * FROM ga")
def _(t):
    return rt.relevance_gate(matches(t), queries(t))


RETRIEVE_SQL = MATCH_SQL + f""",
rk AS (SELECT ga.*, first_turn, length(tu.text) AS characters, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coverage DESC, first_turn DESC, ga.turn_id) AS place FROM ga JOIN qs USING (query_id, conv_id) JOIN tu ON tu.turn_id = ga.turn_id WHERE relevant AND score > 0),
p1 AS (SELECT query_id, min(place) AS place FROM rk WHERE characters <= {BUDGET} GROUP BY 1), q1 AS (SELECT rk.*, 1 AS rank, {BUDGET} - characters AS room FROM rk JOIN p1 USING (query_id, place)),
p2 AS (SELECT rk.query_id, min(rk.place) AS place FROM rk JOIN q1 ON q1.query_id = rk.query_id AND rk.place > q1.place AND rk.characters <= room GROUP BY 1), q2 AS (SELECT rk.*, 2 AS rank, q1.room - rk.characters AS room FROM rk JOIN p2 USING (query_id, place) JOIN q1 ON q1.query_id = rk.query_id),
p3 AS (SELECT rk.query_id, min(rk.place) AS place FROM rk JOIN q2 ON q2.query_id = rk.query_id AND rk.place > q2.place AND rk.characters <= room GROUP BY 1), q3 AS (SELECT rk.*, 3 AS rank, 0 AS room FROM rk JOIN p3 USING (query_id, place)),
re AS (SELECT query_id, turn_id, row_number() OVER (PARTITION BY query_id ORDER BY first_turn, turn_id) AS position, {big('rank')} AS rank, score, coverage, {big('characters')} AS characters FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3))"""


def retrieved(t):
    return rt.retrieve(rt.relevance_gate(matches(t), queries(t)), corpus(t), queries(t), budget=BUDGET)


@query("retrieve", f"WITH {RETRIEVE_SQL} SELECT * FROM re")
def _(t):
    return retrieved(t)


# Questions that only refer back, asked of every conversation after its last turn; every third conversation sets a task early on.
TASK_SQL = "CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN text || ' 参数 窗口 设为 zeta-' || conv_id || ' quorum_9 fjordline kestrel' ELSE text END"
FOCUS_SQL = MATCH_SQL.replace("ELSE text END AS text FROM conversations)", f"ELSE text END AS text FROM (SELECT * REPLACE ({TASK_SQL} AS text) FROM conversations))") + f""",
fo AS (SELECT nm.conv_id, conv_id || ':' || turn_no AS turn_id, min(turn) AS first_turn, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), string_agg(text, chr(10) ORDER BY turn)) AS text FROM nm GROUP BY nm.conv_id, turn_no),
fw AS (SELECT DISTINCT turn_id, conv_id, term FROM {terms_sql('fo', 'turn_id, conv_id')} WHERE NOT starts_with(term, '@concept.')),
fd AS (SELECT conv_id, term, count(*) AS df FROM fw GROUP BY 1, 2), fn AS (SELECT conv_id, count(*) AS docs FROM fo GROUP BY 1),
fr AS (SELECT turn_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) AS w, row_number() OVER (PARTITION BY turn_id ORDER BY ln(1 + (docs - df + 0.5) / (df + 0.5)) DESC) AS k FROM fw JOIN fd USING (conv_id, term) JOIN fn USING (conv_id)),
fs AS (SELECT fo.conv_id, fo.turn_id, first_turn, {r(f"coalesce(i, 0) + least(3, {' + '.join(f'contains(lower(text), {chr(39)}{a}{chr(39)})::INT' for a in rt.ACTIONS)}) * 1.25")} AS score FROM fo JOIN (SELECT turn_id AS t FROM tu) ON t = fo.turn_id LEFT JOIN (SELECT turn_id, sum(w) AS i FROM fr WHERE k <= 8 GROUP BY 1) f ON f.turn_id = fo.turn_id),
fk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, first_turn DESC, turn_id) AS k FROM fs)"""


@query("reference_focus", f"""WITH {FOCUS_SQL} SELECT a.conv_id AS query_id, a.turn_id, a.score FROM fk a LEFT JOIN fk b ON b.conv_id = a.conv_id AND b.k = 2
WHERE a.k = 1 AND a.score >= 4.0 AND (b.score IS NULL OR a.score >= b.score + 2.0 OR a.score >= b.score * 1.35)""")
def _(t):
    """The turn that "as before" means, where one is clear."""
    c, k = t.read("conversations"), F.col("conv_id") % 3
    task = F.concat(F.col("text"), F.lit(" 参数 窗口 设为 zeta-"), F.col("conv_id").cast("string"), F.lit(" quorum_9 fjordline kestrel"))
    c = c.withColumn("text", F.when((F.col("turn") == 0) & (k == 0), task).otherwise(F.col("text")))
    c = c.withColumn("text", F.when(k == 0, F.concat(F.col("text"), F.lit(" 导出 chart run_7"))).when(k == 1, F.concat(F.col("text"), F.lit(" 同期 图表 lead-lag"))).otherwise(F.col("text")))
    all_turns = t.keep(rt.group_turns(c))
    last = all_turns.groupBy("conv_id").agg(F.max_by("turn_id", "turn_no").alias("turn_id"))
    found, asked = rt.without_recent(all_turns, last), all_turns.select(F.col("conv_id").alias("query_id"), "conv_id", F.lit("继续按刚才那个做").alias("text")).distinct()
    gated = rt.relevance_gate(rt.bm25_matches(found, asked, t.keep), asked)
    return rt.reference_focus(all_turns, found, asked, gated)


@query("score_retrieval", f"""WITH {RETRIEVE_SQL}, gd AS (SELECT query_id, turn_id FROM qs JOIN al USING (conv_id) WHERE turn_no = 1), j AS (SELECT re.turn_id IS NOT NULL AS f, gd.turn_id IS NOT NULL AS g FROM re FULL JOIN gd ON re.query_id = gd.query_id AND re.turn_id = gd.turn_id)
SELECT {big('count_if(f)')} AS found, {big('count_if(g)')} AS relevant, {big('count_if(f AND g)')} AS hits, {r('count_if(f AND g) / count_if(f)')} AS precision, {r('count_if(f AND g) / count_if(g)')} AS recall FROM j""")
def _(t):
    gold = turns(t).where(F.col("turn_no") == 1).join(queries(t).select("query_id", "conv_id"), "conv_id").select("query_id", "turn_id")
    return rt.score_retrieval(retrieved(t), gold)
