"""Ranked retrieval of earlier conversation turns: tokens, turns, BM25, relevance gate, budgeted top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, r6
from .common import prefix_sums, top_k

# Ranking constants and the wordings that stand for one concept.
K1, B = 1.5, 0.75
COMMON_RATIO, MIN_COVERAGE, COMMON_ONLY_COVERAGE = 0.65, 0.25, 0.75
CONCEPTS = {
    "@concept.visual": ("图表", "图形", "可视化", "绘图", "chart", "plot", "visualization"),
    "@concept.persist": ("导出", "写入", "保存", "输出", "落盘", "export", "save", "write"),
    "@concept.artifact_directory": ("报告目录", "报告文件夹", "产物目录", "产物文件夹", "输出目录", "结果目录", "artifact directory", "artifact folder", "report directory"),
    "@concept.contemporaneous": ("同期", "同时关系", "当期关系", "同步关系", "contemporaneous"),
    "@concept.lead_lag": ("领先滞后", "时滞关系", "延迟关系", "lead-lag", "lead lag", "lagged relationship"),
    "@concept.feature": ("外生变量", "驱动变量", "驱动因子", "候选特征", "exogenous variable", "driver feature"),
}

# Wordings of a question that only refers back, wordings that set a task, and the limits of a clear focus.
REFERENCE_ONLY = ("刚才那个", "之前那个", "前面那个", "上次那个", "按刚才", "按之前", "照刚才", "照之前", "沿用之前", "按原来", "照旧")
ACTIONS = ("设为", "设置", "调整", "改为", "要求", "限制", "目标", "方案", "参数", "分析", "导出", "保存", "使用", "采用", "窗口")
FOCUS_TERMS, FOCUS_ACTIONS, ACTION_WEIGHT, FOCUS_LEAST, FOCUS_LEAD, FOCUS_RATIO = 8, 3, 1.25, 4.0, 2.0, 1.35


def tokens(text: str) -> Column:
    """ASCII words whole, CJK runs as overlapping pairs; then one term per concept the text names."""
    low = F.lower(F.col(text))
    found = F.regexp_extract_all(low, F.lit(r"([一-鿿]+|[A-Za-z0-9_-]+)"), F.lit(1))
    split = F.flatten(F.transform(found, lambda run: F.when(run.rlike(r"^[\x00-\x7F]") | (F.length(run) == 1), F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda j: F.substr(run, j, F.lit(2))))))
    concepts = F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), F.lit(c)) for c, words in CONCEPTS.items()]))
    return F.concat(split, concepts)


def tokenize(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("terms", tokens(text))


def group_turns(messages: DataFrame) -> DataFrame:
    """A user message with the replies that follow it is one turn; replies before any user message are turn 0."""
    m = prefix_sums(messages, ["conv_id"], "turn", {"turn_no": (F.col("role") == "user").cast("long")})
    said = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    joined = lambda a: F.array_join(F.transform(a, lambda s: s["text"]), "\n")
    g = m.groupBy("conv_id", "turn_no").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("messages"), joined(said).alias("text"), joined(F.filter(said, lambda s: s["role"] == "user")).alias("user_text"))
    return g.withColumn("turn_id", F.concat_ws(":", "conv_id", "turn_no"))


def term_counts(turns: DataFrame) -> DataFrame:
    """Inverted index rows (turn_id, term, tf, length). Terms are counted inside each task before the shuffle."""
    t = turns.select("turn_id", "conv_id", tokens("text").alias("_t")).withColumn("length", F.size("_t").cast("long"))
    return t.select("turn_id", "conv_id", "length", F.explode("_t").alias("term")).groupBy("turn_id", "conv_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "conv_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))


def bm25_matches(turns: DataFrame, queries: DataFrame, keep=lambda df: df) -> DataFrame:
    """One row per query, turn of its conversation and shared term, with its score part.

    The corpus of a query is its own conversation, so queries never meet the turns of others however common a
    word is. `keep` cuts the plan at the index, which is read twice.
    """
    index = keep(term_counts(turns))
    size = turns.select("conv_id", F.size(tokens("text")).alias("n")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("_docs"), F.avg("n").alias("_avg"))
    qt = query_terms(queries).join(size, "conv_id")
    df = index.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("df"))
    m = qt.join(df, ["conv_id", "term"]).join(index, ["conv_id", "term"])
    idf = F.log(1 + (F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("_avg")))
    return m.select("query_id", "turn_id", "conv_id", "term", part.alias("part"), "df", F.col("_docs").alias("docs"))


def bm25(matches: DataFrame) -> DataFrame:
    return matches.groupBy("query_id", "turn_id").agg(r6(F.sum("part")).alias("score"), F.count(F.lit(1)).alias("matched_terms"))


def relevance_gate(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """Which matches are more than overlap of corpus-wide words."""
    q = query_terms(queries)
    concept = lambda c: F.col(c).startswith("@concept.")
    qn = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("_q"), count_if(concept("term")).alias("_qc"))
    strong = ~concept("term") & F.col("term").rlike(r"^[\x00-\x7F]") & F.col("term").rlike(r"[_\-0-9]")
    common = (F.col("docs") >= 4) & (F.col("df") / F.col("docs") > COMMON_RATIO)
    a = matches.groupBy("query_id", "turn_id", "conv_id").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("matched"), count_if(concept("term")).alias("_c"), F.max(strong.cast("int")).alias("_id"), count_if(~common).alias("_rare"))
    j = a.join(qn, "query_id")
    lex = F.col("matched") / F.col("_q")
    by_concept = (F.col("_c") >= 2) & (F.col("_c") / F.col("_qc") >= 0.5)
    enough = (F.col("matched") >= F.when(F.col("_q") <= 2, 1).otherwise(2)) & (lex >= MIN_COVERAGE)
    only_common = (F.col("_rare") == 0) & ((F.col("_q") <= 2) | (lex < COMMON_ONLY_COVERAGE))
    return j.select("query_id", "turn_id", "conv_id", r6("score").alias("score"), F.col("matched").alias("matched_terms"),
                    r6(F.when(by_concept, F.col("_c") / F.col("_qc")).when(F.col("_id") == 1, F.lit(1.0)).otherwise(lex)).alias("coverage"), (by_concept | (F.col("_id") == 1) | (enough & ~only_common)).alias("relevant"))


def without_recent(turns: DataFrame, recent: DataFrame) -> DataFrame:
    """The corpus that is searched: turns already in view, (turn_id) of `recent`, neither match nor count in its statistics."""
    return turns.join(recent.select("turn_id").distinct(), "turn_id", "left_anti")


def retrieve(gated: DataFrame, turns: DataFrame, queries: DataFrame, k: int = 3, budget: int = 6000) -> DataFrame:
    """Best k relevant turns of the query's own conversation that fit the budget, in time order.

    The ranking is walked down: a turn longer than what is left of the budget is passed over, not the end of the walk.
    Since room only shrinks, the next pick is the best turn behind the last one that fits; each is one aggregate per query.
    """
    g = gated.where(F.col("relevant") & (F.col("score") > 0)).join(queries.select("query_id", "conv_id"), ["query_id", "conv_id"])
    g = g.join(turns.select("turn_id", "first_turn", F.length("text").cast("long").alias("characters")), "turn_id")
    place = F.struct((-F.col("score")).alias("a"), (-F.col("coverage")).alias("b"), (-F.col("first_turn")).alias("c"), F.col("turn_id").alias("d"))
    g = g.where(F.col("characters") <= budget).withColumn("_place", place)
    row = F.struct("turn_id", "first_turn", "score", "coverage", "characters")
    picks, state = None, None
    for n in range(1, k + 1):
        left = g if state is None else g.join(state, "query_id").where((F.col("_place") > F.col("_last")) & (F.col("characters") <= F.col("_room")))
        room = F.lit(budget).cast("long") if state is None else F.max("_room")
        pick = left.groupBy("query_id").agg(F.min_by(row, F.col("_place")).alias("_r"), F.min("_place").alias("_last"), room.alias("_had"))
        state = pick.select("query_id", "_last", (F.col("_had") - F.col("_r.characters")).alias("_room"))
        one = pick.select("query_id", F.lit(n).cast("long").alias("rank"), "_r.*")
        picks = one if picks is None else picks.unionByName(one)
    w = Window.partitionBy("query_id").orderBy("first_turn", "turn_id")                                     # at most k rows
    return picks.withColumn("position", F.row_number().over(w).cast("long")).select("query_id", "turn_id", "position", "rank", "score", "coverage", "characters")


def reference_focus(turns: DataFrame, candidates: DataFrame, queries: DataFrame, gated: DataFrame) -> DataFrame:
    """The one earlier turn a question means that only refers back ("as before") and matches nothing itself.

    A turn's focus is the weight of its rarest words, by the turns of its conversation, and of wordings that set a task, in
    what the user said. It counts only if it is clear: strong enough, and well ahead of the second. Turns in view count in
    the word statistics, but only `candidates` can be found.
    """
    low = F.lower(F.trim("text"))
    refers = lambda c, words: [c.contains(w) for w in words]
    q = queries.where(F.greatest(*[x.cast("int") for x in refers(low, REFERENCE_ONLY)]) == 1).join(gated.where(F.col("relevant") & (F.col("score") > 0)).select("query_id").distinct(), "query_id", "left_anti")
    focus = (turns.join(q.select("conv_id").distinct(), "conv_id", "left_semi")
                  .select("turn_id", "conv_id", "first_turn", F.when(F.col("user_text") != "", F.col("user_text")).otherwise(F.col("text")).alias("focus_text")))
    docs = focus.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_docs"))
    word = focus.select("turn_id", "conv_id", F.explode(F.array_distinct(tokens("focus_text"))).alias("term")).where(~F.col("term").startswith("@concept."))
    df = word.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("df")).join(docs, "conv_id")
    weight = F.log(1 + (F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    best = F.slice(F.reverse(F.array_sort(F.collect_list(weight))), 1, FOCUS_TERMS)                       # the words of one turn
    info = word.join(df, ["conv_id", "term"]).groupBy("turn_id").agg(F.aggregate(best, F.lit(0.0), lambda a, x: a + x).alias("_info"))
    acts = F.least(F.lit(FOCUS_ACTIONS), sum((x.cast("int") for x in refers(F.lower("focus_text"), ACTIONS)), F.lit(0)))
    scored = (focus.join(candidates.select("turn_id"), "turn_id", "left_semi").join(info, "turn_id", "left")
                   .select("turn_id", "conv_id", "first_turn", r6(F.coalesce("_info", F.lit(0.0)) + acts * ACTION_WEIGHT).alias("score")))
    two = top_k(q.select("query_id", "conv_id").join(scored, "conv_id"), ["query_id"], [F.desc("score"), F.desc("first_turn"), "turn_id"], 2)
    one = two.groupBy("query_id").agg(F.min_by("turn_id", "rank").alias("turn_id"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_second"))
    clear = F.col("_second").isNull() | (F.col("score") >= F.col("_second") + FOCUS_LEAD) | (F.col("score") >= F.col("_second") * FOCUS_RATIO)
    return one.where((F.col("score") >= FOCUS_LEAST) & clear).select("query_id", "turn_id", "score")


def score_retrieval(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Micro precision and recall of (query_id, turn_id) against gold."""
    f, g = found.select("query_id", "turn_id").distinct().withColumn("_f", F.lit(1)), gold.select("query_id", "turn_id").distinct().withColumn("_g", F.lit(1))
    j = f.join(g, ["query_id", "turn_id"], "full").na.fill({"_f": 0, "_g": 0})
    a = j.agg(F.sum("_f").alias("found"), F.sum("_g").alias("relevant"), F.sum(F.col("_f") * F.col("_g")).alias("hits"))
    return a.withColumn("precision", F.when(F.col("found") > 0, r6(F.col("hits") / F.col("found")))).withColumn("recall", F.when(F.col("relevant") > 0, r6(F.col("hits") / F.col("relevant"))))
