"""Article versions: normalization, identity, quarantine, deduplication, as-of views, chunks and reviews."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import latest, prefix_sums


# Characters that no normal form composes or replaces; texts of these only are NFC as they are.
PLAIN = r"\x00-\u02ff\u0400-\u0482\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u3000-\u3098\u309d-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffee"
SPACES = r"\t\x0b\x0c\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@F.udf(T.StringType(), useArrow=False)
def _nfc(text: str | None) -> str | None:
    """Row by row: a worker holds a hundred whole texts at a time, where an Arrow batch holds ten thousand or 64 MB."""
    return None if text is None else unicodedata.normalize("NFC", text)


def composed(c: Column) -> Column:
    """Text in NFC. Only texts with a character outside PLAIN leave the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(f"[^{PLAIN}]"), c)), c)


def normalize_text(col) -> Column:
    """NFC, one newline form, single spaces inside lines, no blank lines at the edges."""
    c = composed(F.col(col) if isinstance(col, str) else col)
    t = F.regexp_replace(c, r"\r\n?", "\n")
    t = F.regexp_replace(t, f"[{SPACES}]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def digest(*cols) -> Column:
    """sha256 of the given parts joined by a separator that text does not hold; NULL parts count as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def normalize_documents(records: DataFrame) -> DataFrame:
    """Immutable versions: normalized text, content/document/version ids, availability and sorted tags."""
    r = records.withColumn("title", normalize_text("title")).withColumn("body", normalize_text("body"))
    r = r.withColumn("content_hash", digest("title", "body"))
    r = r.withColumn("document_id", F.concat(F.lit("doc_"), F.substring(digest("source_name", "source_document_id"), 1, 24)))
    r = r.withColumn("document_version_id", F.concat(F.lit("ver_"), F.substring(digest("document_id", "version", "content_hash"), 1, 24)))
    return (r.withColumn("available_at", F.greatest("published_at", "collected_at")).withColumn("first_seen_at", F.col("collected_at"))
             .withColumn("market_tags", F.array_sort(F.array_distinct("market_tags"))))


def canonical_url(col) -> Column:
    """Lower-case scheme and host, no fragment, no `utm_` parameters."""
    u = F.trim(F.col(col) if isinstance(col, str) else col)
    scheme, host, path = F.lower(F.parse_url(u, F.lit("PROTOCOL"))), F.lower(F.parse_url(u, F.lit("AUTHORITY"))), F.parse_url(u, F.lit("PATH"))
    params = F.filter(F.split(F.coalesce(F.parse_url(u, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    query = F.array_join(params, "&")
    return F.concat(scheme, F.lit("://"), host, F.coalesce(path, F.lit("")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


# Source types from most to least preferred, and the accepted content scopes.
SOURCE_PRIORITY = ("government_regulator", "grid_market_operator", "meteorological", "company_official", "authoritative_media", "industry_media", "aggregator")
CONTENT_SCOPES = ("full_text", "excerpt", "summary")
REQUIRED = ("source_name", "source_url", "source_type", "title", "content", "published_at", "fetched_at", "search_query_id")


def validate_records(raw: DataFrame, query_ids: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Adds `reason`: NULL for usable records, else the first rule a record breaks. Times are still text here.

    A record without one of the `required` fields, or with an empty one, is not usable.
    """
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in sorted(required)]))
    j = raw.join(query_ids.select(F.col("query_id").alias("search_query_id"), F.lit(True).alias("_known")), "search_query_id", "left")
    offset = lambda c: F.col(c).rlike(r"(Z|[+-]\d{2}:\d{2})$")
    when = lambda c: F.col(c).try_cast("timestamp")
    reason = (F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))).when(F.col("_known").isNull(), "unknown search_query_id")
               .when(when("published_at").isNull() | when("fetched_at").isNull(), "invalid timestamp")
               .when(~offset("published_at") | ~offset("fetched_at"), "timestamps require an offset").when(when("fetched_at") < when("published_at"), "fetched before published")
               .when(~F.coalesce(F.col("content_scope"), F.lit("excerpt")).isin(*CONTENT_SCOPES), "unsupported content scope"))
    return j.withColumn("reason", reason).drop("_known")


def content_key(title, content) -> Column:
    """Hash of the case-folded text with all whitespace runs as one space."""
    t = F.concat(F.col(title), F.lit("\n"), F.col(content))
    return F.sha2(F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))), 256)


def dedup_records(valid: DataFrame) -> DataFrame:
    """One record per (URL, content): best source type, then earliest publication. Adds `copies`."""
    rank = F.coalesce(*[F.when(F.col("source_type") == s, F.lit(j)) for j, s in enumerate(SOURCE_PRIORITY)], F.lit(99))
    v = valid.withColumn("url", canonical_url("source_url")).withColumn("content_hash", content_key("title", "content"))
    rest = [c for c in v.columns if c not in ("url", "content_hash")]
    g = v.groupBy("url", "content_hash").agg(F.min_by(F.struct(*rest), F.struct(rank, F.col("published_at"), F.col("record_id"))).alias("_r"), F.count(F.lit(1)).alias("copies"))
    return g.select("url", "content_hash", *[F.col(f"_r.{c}") for c in rest], "copies")


def version_store(docs: DataFrame) -> DataFrame:
    """One row per version id, seen first by its earliest collection; flags conflicting repeats and repeated content."""
    v = docs.groupBy("document_id", "document_version_id", "version").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.min("available_at").alias("available_at"), F.count(F.lit(1)).alias("collections"), F.min("content_hash").alias("content_hash"),
        ((F.min("content_hash") != F.max("content_hash")) | (F.min(F.array_join("market_tags", ",")) != F.max(F.array_join("market_tags", ",")))).alias("conflict"))
    same = v.groupBy("document_id", "content_hash").agg(F.count(F.lit(1)).alias("versions_with_content"))
    return v.join(same, ["document_id", "content_hash"])


def history(versions: DataFrame, as_of) -> DataFrame:
    """Every version that had arrived by `as_of`."""
    return versions.where(F.col("available_at") <= (as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")))


def visible_documents(versions: DataFrame, as_of) -> DataFrame:
    """Newest arrived version of every document at `as_of`."""
    return latest(history(versions, as_of), ["document_id"], ["available_at", "version"])


def replay(versions: DataFrame) -> DataFrame:
    """At every instant something arrives: how many documents and versions are visible from then on.

    Each document counts from its first version, so both counts are running sums over instants.
    """
    first = versions.groupBy("document_id").agg(F.min("available_at").alias("instant")).groupBy("instant").agg(F.count(F.lit(1)).alias("new_documents"))
    per = versions.groupBy(F.col("available_at").alias("instant")).agg(F.count(F.lit(1)).alias("new_versions"))
    j = per.join(first, "instant", "left").withColumn("_t", F.unix_seconds("instant")).withColumn("_k", F.lit(0))
    daily = prefix_sums(j, ["_k"], "_t", {"visible_documents": F.coalesce("new_documents", F.lit(0)), "visible_versions": F.col("new_versions")}, chunk=1, span=3600)
    return daily.select("instant", F.coalesce("new_documents", F.lit(0)).alias("new_documents"), "new_versions", "visible_documents", "visible_versions")


def route_market(docs: DataFrame, market: str) -> DataFrame:
    """`routed` is true for documents tagged with the market; the rest carry the quarantine reason."""
    ok = F.array_contains("market_tags", market)
    return docs.withColumn("routed", ok).withColumn("quarantine_reason", F.when(~ok, F.lit("market_mismatch")))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _ranges(text: pd.Series, budget: pd.Series) -> pd.Series:
    def cut(s, size):
        out, at = [], 0
        while s is not None and at < len(s):
            end = min(at + size, len(s))
            if end < len(s):
                for mark in ("\n\n", "\n", "。", ". "):
                    k = s.rfind(mark, at, end)
                    if k >= at + size // 2:
                        end = k + len(mark)
                        break
            out.append({"start": at, "end": end})
            at = end
        return out
    return pd.Series([cut(s, int(b)) for s, b in zip(text, budget)])


def chunk_documents(docs: DataFrame, budget: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut whole texts at blank lines, newlines or full stops into pieces of at most `budget` characters, with offsets."""
    # cut before the rows are opened, so that a piece does not carry the whole text
    piece = lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.substring(F.col(text), r["start"].cast("int") + 1, (r["end"] - r["start"]).cast("int")).alias("text"))
    d = docs.select(id_col, F.transform(_ranges(F.col(text), F.lit(budget)), piece).alias("_r"))
    e = d.select(id_col, F.posexplode("_r").alias("chunk", "_c"))
    return e.select(id_col, F.col("chunk").cast("long").alias("chunk"), F.col("_c.start").alias("start_char"), F.col("_c.end").alias("end_char"), F.col("_c.text").alias("text"))


def apply_reviews(versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each item's newest review as a further version, visible from the review time; unreviewed versions stay as they are."""
    newest = latest(reviews.select("document_version_id", "reviewed_at", "decision", "review_id"), ["document_version_id"], ["reviewed_at", "review_id"])
    base = versions.withColumn("review_status", F.lit("unreviewed"))
    added = (versions.join(newest, "document_version_id").withColumn("available_at", F.greatest("available_at", "reviewed_at"))
             .withColumn("review_status", F.col("decision")).withColumn("version", F.col("version") + 1_000_000).select(*base.columns))
    return base.unionByName(added)
