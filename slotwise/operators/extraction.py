"""Rule-based event extraction over an articles table, entity keys, quantities and evidence checks.

Input columns: document_id, document_version_id, title, body, published_at, available_at.
Every rule is a built-in expression over the whole title and body.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import count_if, to_utc
from .documents import digest

# Event type, relevance, expected price direction and the wordings that mark it.
RULES = (
    ("irrelevant", "irrelevant", "unknown", ("慈善长跑", "员工运动会")),
    ("generation_restore", "short_term", "down", ("已恢复运行", "恢复并网")),
    ("generation_outage", "short_term", "up", ("突发停运", "非计划停运")),
    ("transmission_constraint", "short_term", "up", ("进口能力减少", "输电能力降低")),
    ("demand_shock", "short_term", "up", ("需求激增", "需求预计增加")),
    ("storage_dispatch", "short_term", "down", ("储能(?:电站)?.{0,12}(?:启动|集中)?放电", "储能放电")),
    ("renewable_supply_change", "short_term", "down", ("风电可用出力预计增加", "光伏可用出力预计增加")),
    ("fuel_supply_change", "short_term", "up", ("燃料供应中断", "天然气供应减少")),
    ("policy_long_horizon", "long_horizon", "unknown", (r"计划在\s*20\d{2}\s*年关闭", "长期退役计划")),
)
# Field patterns and relative-day words.
REGION = r"\bTEST_(?:NORTH|SOUTH|EAST|WEST|CENTRAL)\b"
ASSET = r"(?:资产|机组|联络线)[:：\s]+([A-Z][A-Z0-9_-]{1,31})\b"
CAPACITY = (r"(?i)(?:不可用容量|受影响(?:容量)?|(?:可用)?容量恢复|(?:进口|出口|输电|输送|送电)?能力(?:减少|降低|下降|增加|提升)|出力(?:预计)?(?:增加|减少|下降)"
            r"|需求(?:预计)?(?:增加|减少)|预计(?:增加|减少)|增加|减少|恢复)[^0-9]{0,4}(\d+(?:\.\d+)?)\s*MW\b")
INSTANT = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})"
START = rf"(?:事件开始|生效开始|事件发生时间)[:：]\s*({INSTANT})"
END = rf"(?:事件结束|生效结束|预计结束)[:：]\s*({INSTANT})"
DAY_WORDS = {"前日": -2, "昨日": -1, "昨天": -1, "今日": 0, "今天": 0, "当日": 0, "本日": 0, "次日": 1, "翌日": 1, "明日": 1, "明天": 1, "后日": 2}
_DAYS = "|".join(DAY_WORDS)
_CLOCK = r"\d{1,2}[:：]\d{2}"
RANGE = rf"({_DAYS})\s*({_CLOCK})\s*(?:[—–\-－~～]|至|到)\s*({_CLOCK})"
POINT = rf"({_DAYS})\s*({_CLOCK})"
VALUELESS = ("irrelevant", "unknown")


def classify(docs: DataFrame) -> DataFrame:
    """Event type per document; several types quarantine it, none makes it unknown."""
    hit = lambda pats: F.col("title").rlike("|".join(f"(?:{p})" for p in pats)) | F.col("body").rlike("|".join(f"(?:{p})" for p in pats))
    matched = F.array_compact(F.array(*[F.when(hit(p), F.lit(t)) for t, _, _, p in RULES]))
    d = docs.withColumn("matched_types", matched)
    etype = F.when(F.size("matched_types") == 1, F.col("matched_types")[0]).when(F.size("matched_types") == 0, "unknown")
    pick = lambda j, other: F.coalesce(*[F.when(F.col("event_type") == r[0], F.lit(r[j])) for r in RULES], F.lit(other))
    d = d.withColumn("event_type", etype)
    return (d.withColumn("relevance", F.when(F.col("event_type").isNotNull(), pick(1, "irrelevant"))).withColumn("direction", F.when(F.col("event_type").isNotNull(), pick(2, "unknown")))
             .withColumn("quarantine_reason", F.when(F.size("matched_types") > 1, F.lit("ambiguous_multi_event"))))


def first_match(pattern: str) -> Column:
    """First match in the body, else in the title; NULL when neither has one. Groups are taken from the match."""
    return F.coalesce(F.regexp_substr("body", F.lit(pattern)), F.regexp_substr("title", F.lit(pattern)))


def capture_fields(docs: DataFrame) -> DataFrame:
    """Distinct regions and assets (title before body) and the qualified MW with its place in the text."""
    both = lambda p, g: F.array_distinct(F.concat(F.regexp_extract_all("title", F.lit(p), F.lit(g)), F.regexp_extract_all("body", F.lit(p), F.lit(g))))
    d = docs.withColumns({"affected_regions": both(REGION, 0), "affected_assets": both(ASSET, 1), "_cb": F.regexp_substr("body", F.lit(CAPACITY)), "_ct": F.regexp_substr("title", F.lit(CAPACITY))})
    whole, in_body = F.coalesce("_cb", "_ct"), F.col("_cb").isNotNull()
    d = d.withColumns({"capacity_quote": F.regexp_extract(whole, CAPACITY, 1), "capacity_text_field": F.when(in_body, "body").when(F.col("_ct").isNotNull(), "title")})
    source = F.when(in_body, F.col("body")).otherwise(F.col("title"))
    start = F.when(whole.isNotNull(), F.regexp_instr(source, F.lit(CAPACITY)) - 1 + F.length(F.regexp_extract(whole, r"^([^0-9]*)", 1)))
    return (d.withColumn("capacity_mw", F.col("capacity_quote").try_cast("double")).withColumn("capacity_start", start.cast("long"))
             .withColumn("capacity_end", F.col("capacity_start") + F.length("capacity_quote")).drop("_cb", "_ct"))


def _clock_instant(day: Column, clock: Column, tz: str) -> Column:
    c = F.replace(clock, F.lit("："), F.lit(":"))
    h, m = F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int"), F.split_part(c, F.lit(":"), F.lit(2)).try_cast("int")
    offset = F.coalesce(*[F.when(day == w, F.lit(o)) for w, o in DAY_WORDS.items()])
    local = F.date_add(F.to_date(F.from_utc_timestamp("published_at", tz)), offset).cast("timestamp")
    return F.when(h.between(0, 23) & m.between(0, 59), to_utc(F.timestamp_seconds(F.unix_seconds(local) + h * 3600 + m * 60), tz))


def resolve_times(docs: DataFrame, tz: str = "UTC") -> DataFrame:
    """Effective start and end: a stated instant, else a relative day with clock times on the publication date.

    A range that reads backwards ends on the next day; several different
    relative times without a range are ambiguous and resolve nothing.
    """
    at = lambda p: F.regexp_extract(first_match(p), p, 1).try_cast("timestamp")
    d = docs.withColumn("_s", at(START)).withColumn("_e", at(END))
    # Matches become columns before they are read several times.
    d = d.withColumns({"_range": first_match(RANGE), "_point": first_match(POINT)})
    part = lambda c, pattern, group: F.regexp_extract(c, pattern, group)
    d = d.withColumns({"_rd": part("_range", RANGE, 1), "_r1": part("_range", RANGE, 2), "_r2": part("_range", RANGE, 3), "_pd": part("_point", POINT, 1), "_pc": part("_point", POINT, 2)})
    d = d.withColumn("_rs", _clock_instant(F.col("_rd"), F.col("_r1"), tz)).withColumn("_re", _clock_instant(F.col("_rd"), F.col("_r2"), tz))
    d = d.withColumn("_re", F.when(F.col("_re") < F.col("_rs"), F.col("_re") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("_re")))
    norm = lambda a: F.transform(a, lambda s: F.regexp_replace(F.regexp_replace(s, "：", ":"), r"\s", ""))
    points = F.array_distinct(F.concat(norm(F.regexp_extract_all("body", F.lit(POINT), F.lit(0))), norm(F.regexp_extract_all("title", F.lit(POINT), F.lit(0)))))
    d = d.withColumn("_n", F.size(points)).withColumn("_ps", _clock_instant(F.col("_pd"), F.col("_pc"), tz))
    stated, ranged = F.col("_s").isNotNull(), F.col("_rs").isNotNull() & F.col("_re").isNotNull()
    return d.select(
        *docs.columns,
        F.when(stated, F.col("_s")).when(ranged, F.col("_rs")).when(F.col("_n") == 1, F.col("_ps")).alias("effective_start_at"),
        F.when(stated, F.col("_e")).when(ranged, F.col("_re")).alias("effective_end_at"),
        F.when(stated, "stated_absolute").when(ranged, "derived_from_publication").when((F.col("_n") == 1) & F.col("_ps").isNotNull(), "derived_from_publication").alias("time_basis"),
        (~stated & ~ranged & (F.col("_n") > 1)).alias("time_ambiguous"))


def event_records(docs: DataFrame, tz: str = "UTC") -> DataFrame:
    """One candidate or one quarantine reason per document version, with the hashed event id."""
    d = resolve_times(capture_fields(classify(docs)), tz)
    carries = ~F.col("event_type").isin(*VALUELESS)
    none = F.array().cast("array<string>")
    keep = lambda c, empty: F.when(carries, F.col(c)).otherwise(empty)
    d = (d.withColumn("affected_regions", keep("affected_regions", none)).withColumn("affected_assets", keep("affected_assets", none)).withColumn("capacity_mw", keep("capacity_mw", F.lit(None)))
          .withColumn("effective_start_at", keep("effective_start_at", F.lit(None))).withColumn("effective_end_at", keep("effective_end_at", F.lit(None))))
    reason = (F.when(F.col("quarantine_reason").isNotNull(), F.col("quarantine_reason")).when(carries & F.col("time_ambiguous"), "ambiguous_event_time")
               .when((F.col("relevance") == "short_term") & F.col("effective_start_at").isNull(), "missing_effective_start"))
    d = d.withColumn("quarantine_reason", reason)
    d = canonical_entities(d, "affected_regions", "affected_assets")
    ident = digest(F.array_join("region_keys", ","), F.array_join("asset_keys", ","), F.date_format("effective_start_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_type"),
                   F.when(F.col("event_type").isin(*VALUELESS), F.col("document_id")))
    return d.withColumn("event_id", F.when(F.col("quarantine_reason").isNull(), F.concat(F.lit("evt_"), F.substring(ident, 1, 24))))


# Operator and administrative endings of region names, and known regions.
REGION_SUFFIXES = ("电网公司", "电力公司", "电力集团", "供电公司", "电网", "电力", "全网", "全省", "全市", "省份", "省", "市", "自治区", "地区", "区域", "电网区域")
REGIONS = {
    "江苏": "CN-JIANGSU", "广东": "CN-GUANGDONG", "广西": "CN-GUANGXI", "浙江": "CN-ZHEJIANG", "辽宁": "CN-LIAONING", "吉林": "CN-JILIN", "黑龙江": "CN-HEILONGJIANG",
    "山东": "CN-SHANDONG", "山西": "CN-SHANXI", "天津": "CN-TIANJIN", "北京": "CN-BEIJING", "上海": "CN-SHANGHAI", "安徽": "CN-ANHUI", "福建": "CN-FUJIAN", "河南": "CN-HENAN",
    "河北": "CN-HEBEI", "湖南": "CN-HUNAN", "湖北": "CN-HUBEI", "四川": "CN-SICHUAN", "全国": "CN-NATIONAL", "中国": "CN-NATIONAL", "华东": "CN-EAST", "华北": "CN-NORTH",
    "华中": "CN-CENTRAL", "华南": "CN-SOUTH", "西北": "CN-NORTHWEST", "东北": "CN-NORTHEAST", "greatbritain": "GB", "britain": "GB", "unitedkingdom": "GB", "uk": "GB", "gb": "GB",
    "england": "GB", "texas": "ERCOT", "ercot": "ERCOT", "qld": "NEM-QLD", "queensland": "NEM-QLD", "nemqld": "NEM-QLD",
}
_FULL = "".join(chr(0xFF01 + j) for j in range(94)) + "　"
_HALF = "".join(chr(0x21 + j) for j in range(94)) + " "


# Characters that the JVM folds like NFKC and case folding do: ASCII, ideographs and full-width forms.
SIMPLE = r"\x00-\x7f\u3000\u4e00-\u9fff\uff01-\uff5e"


def _folded(s: str) -> str:
    return unicodedata.normalize("NFKC", s).casefold()


@F.pandas_udf(T.StringType())
def _fold_text(text: pd.Series) -> pd.Series:
    return text.map(_folded, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_texts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [None if s is None else _folded(s) for s in a])


def narrowed(c: Column) -> Column:
    """NFKC and folded case where a text has characters beyond SIMPLE; other texts stay in the JVM."""
    return F.coalesce(_fold_text(F.when(c.rlike(f"[^{SIMPLE}]"), c)), c)


def all_narrowed(c: Column) -> Column:
    """`narrowed` for every text of an array."""
    return F.coalesce(_fold_texts(F.when(F.exists(c, lambda s: s.rlike(f"[^{SIMPLE}]")), c)), c)


def fold(c: Column) -> Column:
    """Comparable characters only, of narrowed text: full-width forms narrowed, punctuation and spaces dropped, lower case."""
    return F.lower(F.regexp_replace(F.translate(c, _FULL, _HALF), r"[^\p{L}\p{N}_]", ""))


def _table(pairs, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), key)


def _stem(f: Column) -> Column:
    """A folded name without its operator and administrative endings."""
    return F.regexp_replace(f, "^(..+?)(?:" + "|".join(sorted(set(REGION_SUFFIXES), key=len, reverse=True)) + ")+$", "$1")


def _coded(f: Column, stem: Column) -> Column:
    codes = {code.replace("-", "").lower(): code for code in REGIONS.values()}
    return F.coalesce(_table(codes.items(), f), _table(REGIONS.items(), stem), stem)


def canonical_region(c: Column) -> Column:
    """Known code, or the folded name without its operator and administrative endings (at least two characters stay)."""
    return _coded(fold(c), _stem(fold(c)))


def _known(key: Column) -> Column:
    return key.isin(*sorted(set(REGIONS.values())))


def canonical_entities(df: DataFrame, regions: str = "regions", assets: str = "assets") -> DataFrame:
    """Sorted distinct keys: `region_keys`, with region names that were listed as assets moved in, and `asset_keys` of the rest.

    Functions over array elements are evaluated wherever they are written, so every step is a column of its own: a name is
    folded once, and its ending is looked for once.
    """
    d = df.withColumns({"_regions": all_narrowed(F.col(regions)), "_assets": all_narrowed(F.col(assets))})
    d = d.withColumns({"_fr": F.transform("_regions", fold), "_fa": F.transform("_assets", fold)})
    d = d.withColumns({"_sr": F.transform("_fr", _stem), "_sa": F.transform("_fa", _stem)})
    d = d.withColumns({"_cr": F.zip_with("_fr", "_sr", _coded), "_ca": F.zip_with("_fa", "_sa", _coded)})
    keys = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda k: k != "")))
    left = F.zip_with("_fa", "_ca", lambda f, c: F.when(~_known(c), f))
    d = d.withColumns({"region_keys": keys(F.concat("_cr", F.filter("_ca", _known))), "asset_keys": keys(left)})
    return d.drop("_regions", "_assets", "_fr", "_fa", "_sr", "_sa", "_cr", "_ca")


# Parents that name no plant.
UNNAMED_PARENTS = ("powerstation", "powerplant", "plant", "station", "thepowerstation", "theplant", "thepowerplant", "thisplant", "电厂", "电站", "该电厂", "某电厂", "本电厂", "该电站", "某电站")
# Patterns of unit lists and single units under a named plant.
EN_UNITS = r"(?i)^(.+?(?:Power Station|Power Plant|Plant|Station))\s+(?:Generating\s+)?Units\s+(\d+(?:\s*(?:,\s*(?:and\s+)?|and\s+)\d+)+)$"
CN_UNITS = r"^(.+?(?:电厂|电站))\s*(\d+(?:\s*[、,，及和]\s*\d+)+)号机组$"
EN_UNIT = r"(?i)^(.+?(?:Power Station|Power Plant|Plant|Station))\s+(?:Generating\s+)?Unit\s+(\d+)$"
CN_UNIT = r"^(.+?(?:电厂|电站))\s*(\d+)号机组$"
# Folded names of collections and the group they are.
GROUPS = {
    "agrs": "AGR", "agr": "AGR", "advancedgascooledreactorstations": "AGR", "advancedgascooledreactornuclearpowerstations": "AGR", "advancedgascooledreactors": "AGR",
    "coalfleet": "coal_fleet", "coalplants": "coal_fleet", "windgeneration": "wind_generation", "windfarms": "wind_generation", "solargeneration": "solar_generation",
    "燃煤机组": "coal_fleet", "煤电机组": "coal_fleet", "风电": "wind_generation",
}


def expand_assets(df: DataFrame, mention: str = "mention") -> DataFrame:
    """Explicit unit lists become single units; anything that cannot be split safely gets a reject reason.

    Adds `assets` (array), `reject_reason` and `group_key` (the mention without its leading count, or its known group).
    """
    m = F.trim(F.col(mention))
    en, cn, single = m.rlike(EN_UNITS), m.rlike(CN_UNITS), m.rlike(EN_UNIT)
    base = F.when(en, F.regexp_extract(m, EN_UNITS, 1)).when(cn, F.regexp_extract(m, CN_UNITS, 1)).when(single, F.regexp_extract(m, EN_UNIT, 1))
    ids = F.regexp_extract_all(F.when(en, F.regexp_extract(m, EN_UNITS, 2)).otherwise(F.regexp_extract(m, CN_UNITS, 2)), F.lit(r"(\d+)"), F.lit(1))
    listed = en | cn
    parent = F.coalesce(base, F.when(m.rlike(CN_UNIT), F.regexp_extract(m, CN_UNIT, 1)))
    unnamed = parent.isNotNull() & fold(narrowed(parent)).isin(*UNNAMED_PARENTS)
    bare = m.rlike(r"(?i)^(?:unit\s+\d+|\d+号机组)$")
    ranged = m.rlike(r"(?i)\bunits\b|\d+\s*[-–/、和及或至到~]\s*\d+")
    fleet = m.rlike(r"(?i)\b(?:fleet|generation|plants|reactors|stations)\b|^\d+\s*(?:台|座)")
    reason = (F.when(unnamed | bare, "unnamed_parent").when(listed & (F.size(F.array_distinct(ids)) != F.size(ids)), "repeated_unit").when(~listed & ranged, "not_splittable").when(~listed & fleet, "collection"))
    parts = F.when(en, F.transform(ids, lambda k: F.concat(base, F.lit(" Unit "), k))).when(cn, F.transform(ids, lambda k: F.concat(base, k, F.lit("号机组")))).when(
        single, F.array(F.concat(base, F.lit(" Unit "), F.regexp_extract(m, EN_UNIT, 2)))).otherwise(F.array(m))
    group = fold(F.regexp_replace(F.regexp_replace(narrowed(m), r"^\d+\s+", ""), r"^\d+(?:[.,，]\d+)?\s*(?:座|台|家|个|处|所|套)\s*", ""))
    group = F.coalesce(*[F.when(group == name, F.lit(key)) for name, key in GROUPS.items()], group)
    return df.withColumn("reject_reason", reason).withColumn("assets", F.when(F.col("reject_reason").isNull(), parts)).withColumn("group_key", group)


def matches_market(df: DataFrame, market: str) -> DataFrame:
    """True when the event's market scope is exactly this market; a multi-market total matches none."""
    known = F.filter("region_keys", _known)
    ok = F.array_contains("market_keys", market) & F.when(F.size(known) > 0, (F.size(known) == 1) & (known[0] == market)).otherwise(F.size("market_keys") == 1)
    return df.withColumn("matches_market", ok)


# Power units in MW, and the meanings that count as a capacity change.
POWER_VALUE = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(亿千瓦|万千瓦|千瓦|kW|MW|GW)"
UNIT_MW = {"kw": 0.001, "千瓦": 0.001, "mw": 1.0, "gw": 1000.0, "万千瓦": 10.0, "亿千瓦": 100_000.0}
CHANGE_MEANINGS = ("capacity_change", "generation_loss", "generation_restore", "demand_change", "supply_change", "transfer_change")


def to_mw(unit: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(unit) == u, F.lit(f)) for u, f in UNIT_MW.items()])


def power_values(c: Column) -> Column:
    """Every power quantity of a text in MW."""
    hits = F.regexp_extract_all(c, F.lit(POWER_VALUE), F.lit(0))
    return F.transform(hits, lambda h: F.regexp_replace(F.regexp_extract(h, POWER_VALUE, 1), ",", "").cast("double") * to_mw(F.regexp_extract(h, POWER_VALUE, 2)))


def check_quantities(claims: DataFrame, docs: DataFrame, empty: str | None = "ambiguous_quantity") -> DataFrame:
    """Claimed quantities (document_version_id, value, unit, semantic, raw_text) against the words they quote.

    `empty` is the reason given to quantities of zero or less, which never count as MW; None lets them pass without one.
    """
    j = claims.join(docs.select("document_version_id", "title", "body"), "document_version_id", "left")
    mw = F.col("value") * to_mw(F.col("unit"))
    stated = power_values(F.col("raw_text"))
    close = F.exists(stated, lambda v: F.abs(v - mw) <= F.greatest(F.lit(1e-9), F.greatest(F.abs(v), F.abs(mw)) * 1e-9))
    reason = (F.when(F.col("semantic") == "unknown", "ambiguous_quantity").when(~(F.coalesce(F.contains("body", "raw_text"), F.lit(False)) | F.coalesce(F.contains("title", "raw_text"), F.lit(False))), "invalid_evidence")
               .when(F.size(stated) == 0, "ambiguous_quantity").when(~F.coalesce(close, F.lit(False)), "ambiguous_quantity").when(~(mw > 0), F.lit(empty)))
    return (j.withColumn("reason", reason).withColumn("normalized_mw", F.when(F.col("reason").isNull() & (mw > 0), mw))
             .withColumn("capacity_mw", F.when(F.col("semantic").isin(*CHANGE_MEANINGS), F.col("normalized_mw"))).drop("title", "body"))


# Operational words and the patterns of power quantities and time expressions.
OPERATIONAL = ("停运", "跳闸", "检修", "故障", "事故", "停电", "限电", "负荷", "出力", "发电量", "装机", "并网", "解列", "非计划", "电量", "outage", "tripped", "curtailment", "blackout", "derate")
POWER_QUANTITY = r"\d[\d,]*(?:\.\d+)?\s*(?:万|亿)?\s*(?:[千干]?瓦(?:时)?|[kKmMgG][wW][hH]?)"
TIME_ANCHOR = (
    r"(?:\d{4}\s*年\s*)?\d{1,2}\s*月\s*\d{1,2}\s*日(?:\s*(?:凌晨|上午|中午|午间|下午|傍晚|晚间|夜间)?\s*\d{1,2}\s*[:：时点]\s*\d{1,2}\s*分?)?"
    r"|\d{1,2}\s*日\s*(?:凌晨|上午|中午|午间|下午|傍晚|晚间|夜间)?\s*\d{1,2}\s*[:：时点]\s*\d{1,2}\s*分?"
    r"|\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?Z?"
    r"|(?:\d{4}\s*年\s*)?\d{1,2}\s*月份")


def source_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """What the source demonstrably mentions: power quantities, operational words, distinct time expressions."""
    quantities = F.regexp_extract_all(text, F.lit(POWER_QUANTITY), F.lit(0))
    low = F.lower(text)
    words = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in OPERATIONAL]))
    anchors = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TIME_ANCHOR), F.lit(0)), F.trim))
    return (docs.withColumn("power_quantities", quantities).withColumn("operational_terms", words).withColumn("time_anchors", anchors)
                .withColumn("signals", (F.size("power_quantities") + F.size("operational_terms")).cast("long")))


def disputed(df: DataFrame) -> DataFrame:
    """An "irrelevant" label on a text with operational signals is disputed."""
    return df.withColumn("disputed", (F.col("relevance") == "irrelevant") & (F.col("signals") > 0))


def check_evidence(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Offsets of the n-th occurrence of each quote; `valid` when the text holds that many.

    claims: document_version_id, event_id, field_name, text_field, quote, occurrence.
    """
    j = claims.join(docs.select("document_version_id", "title", "body"), "document_version_id", "left")
    text = F.when(F.col("text_field") == "body", F.col("body")).otherwise(F.col("title"))
    n = (F.length(text) - F.length(F.replace(text, F.col("quote"), F.lit("")))) / F.length("quote")
    literal = F.concat(F.lit("\\Q"), F.replace(F.col("quote"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    start = F.length(F.array_join(F.slice(F.split(text, literal), F.lit(1), F.col("occurrence")), "\u0000")) + (F.col("occurrence") - 1) * (F.length("quote") - 1)
    ok = F.coalesce((F.length("quote") > 0) & (n >= F.col("occurrence")), F.lit(False))
    return (j.withColumn("valid", ok).withColumn("start_char", F.when(F.col("valid"), start.cast("long"))).withColumn("end_char", F.col("start_char") + F.length("quote")).drop("title", "body"))


def evidence_coverage(checked: DataFrame, required: list[str]) -> DataFrame:
    """Required fields of each event that no valid quote covers."""
    g = checked.groupBy("event_id").agg(F.collect_set(F.when(F.col("valid"), F.col("field_name"))).alias("_f"), count_if(~F.col("valid")).alias("invalid_quotes"))
    miss = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required]), F.col("_f")))
    return g.select("event_id", "invalid_quotes", F.array_join(miss, ",").alias("missing_fields"), (F.size(miss) == 0).alias("complete"))


def consensus(passes: DataFrame, runs: int = 3) -> DataFrame:
    """Agreement of several extraction passes per document.

    passes: document_version_id, pass, disposition, reason, event_type, assets, capacity_mw (one row per extracted event;
    quarantined or empty passes have one row with NULL event_type). Each pass folds to an order-free
    signature first, so documents are compared on one row per pass.
    """
    ev = F.when(F.col("event_type").isNotNull(), F.xxhash64(F.concat_ws("|", "event_type", F.array_join(F.array_sort("assets"), ","), F.coalesce(F.round("capacity_mw", 6).cast("string"), F.lit("")))))
    kinds = F.when(F.col("event_type").isNotNull(), F.xxhash64("event_type"))
    sig = passes.groupBy("document_version_id", "pass").agg(
        F.max("disposition").alias("disposition"), F.max("reason").alias("reason"), F.count("event_type").alias("events"),
        F.coalesce(F.sum(F.shiftright(ev, 16)), F.lit(0)).alias("_sig"), F.coalesce(F.sum(F.shiftright(kinds, 16)), F.lit(0)).alias("_types"))
    d = sig.groupBy("document_version_id").agg(
        F.count(F.lit(1)).alias("passes"), (F.min("disposition") == F.max("disposition")).alias("_d"), (F.min("_sig") == F.max("_sig")).alias("_s"), (F.min("_types") == F.max("_types")).alias("_t"),
        (F.min("events") == F.max("events")).alias("_n"), F.max("disposition").alias("_dm"), F.max("events").alias("events"),
        F.mode("reason", True).alias("_mode"))
    agreed = F.col("_d") & F.col("_s") & (F.col("passes") == runs)
    diff = F.array_compact(F.array(F.when(~F.col("_d"), F.lit("disposition")), F.when(~F.col("_n"), F.lit("event_count")), F.when(~F.col("_t"), F.lit("event_type")),
                                   F.when(F.col("_d") & F.col("_t") & F.col("_n") & ~F.col("_s"), F.lit("event_fields"))))
    return d.select("document_version_id", "passes", agreed.alias("agreed"),
                    F.when(F.col("_d") & (F.col("_dm") == "quarantined"), F.col("_mode")).when(~agreed, "inconsistent_extraction").alias("reason"),
                    F.array_join(diff, ",").alias("differing_fields"), F.when(agreed, F.col("events")).alias("events"))
