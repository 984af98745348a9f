"""Verification of generated content against its sources."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of claims and tokens (fixed values).
SENTENCES, CLAIMS, LEAST_CHARS, MOST_CHARS, TOKENS, NUMBERS, ENTAILED = 10, 8, 8, 220, 12, 80, 0.35
#: Words that entailment compares, and years (fixed values).
WORD, YEAR = r"[\x{4E00}-\x{9FA5}]{2,}|[A-Za-z0-9]{3,}", r"(?:19|20)\p{Nd}{2}"


#: What counts as white space, and the marks that end a sentence (fixed values).
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ENDS = "。！？!?；;"


def extract_claims(docs: DataFrame) -> DataFrame:
    """(doc_id, claim_no, text): sentences of at least 8 characters, cut at 220; of the first ten the first eight.

    White space becomes one blank.  A sentence ends at a mark that a blank follows; a text without such a place is split
    at the marks themselves.  Points end no sentence, so decimals stay whole.
    """
    clean = F.btrim(F.regexp_replace("text", SPACE, " "))
    spaced = F.split(F.regexp_replace(clean, f"([{ENDS}]) ", "$1\n"), "\n")
    parts = F.when(F.size(spaced) > 1, spaced).otherwise(F.split(clean, f"[{ENDS}]"))
    trimmed = F.transform(parts, lambda x: F.btrim(x, F.lit(" -\t")))
    kept = F.transform(F.filter(trimmed, lambda x: F.length(x) >= LEAST_CHARS), lambda x: F.substring(x, 1, MOST_CHARS))
    return docs.select("doc_id", F.posexplode(F.slice(F.slice(kept, 1, SENTENCES), 1, CLAIMS)).alias("claim_no", "text"))


def check_citations(claims: DataFrame, citations: DataFrame, sources: DataFrame, strict: bool = True) -> DataFrame:
    """Per document: claims, claims without citation (if ``strict``), invalid citations, and whether it passes.

    A citation (doc_id, claim_no, label, file_id, chunk_id) is invalid if its label, or a file or chunk that it names, is
    none of the document's sources (doc_id, label, file_id, chunk_id).
    """
    cited = citations.select("doc_id", "claim_no").distinct()
    missing = claims.join(cited, ["doc_id", "claim_no"], "left_anti").where(F.lit(strict)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))
    rows = citations
    for name in ("label", "file_id", "chunk_id"):
        rows = rows.join(sources.where(F.col(name).isNotNull()).select("doc_id", name).distinct().withColumn(f"{name}_ok", F.lit(True)), ["doc_id", name], "left")
    ok = F.coalesce("label_ok", F.lit(False)) & (F.col("file_id").isNull() | F.coalesce("file_id_ok", F.lit(False))) & (F.col("chunk_id").isNull() | F.coalesce("chunk_id_ok", F.lit(False)))
    invalid = rows.where(~ok).groupBy("doc_id").agg(F.count(F.lit(1)).alias("invalid"))
    total = claims.groupBy("doc_id").agg(F.count(F.lit(1)).alias("claims"))
    found = total.join(missing, "doc_id", "left").join(invalid, "doc_id", "left").na.fill(0, ["missing", "invalid"])
    return found.withColumn("passed", (F.col("missing") == 0) & (F.col("invalid") == 0))


def source_text(sources: DataFrame) -> DataFrame:
    """All source texts of a document, joined in order of their label; a document has few and bounded sources."""
    ordered = F.array_sort(F.collect_list(F.struct("label", "text")))
    return sources.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("source"))


def entail(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of the distinct ones of a claim's first twelve words (two Han signs or three letters or digits, as written) that the sources contain, and whether it is enough."""
    rows = claims.join(source_text(sources), "doc_id", "left")
    words = F.array_distinct(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, TOKENS))
    held = F.size(F.filter(words, lambda t: F.contains(F.coalesce("source", F.lit("")), t)))
    share = F.coalesce(F.try_divide(held, F.size(words)), F.lit(0.0))
    return rows.select("doc_id", "claim_no", F.bround(share, 2).alias("score"), (share >= ENTAILED).alias("entailed"))


def check_numbers(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Per document with sources: distinct numbers of its claims (the first 80 by claim), and how many no source contains."""
    numbers = claims.select("doc_id", "claim_no", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{Nd}+(?:\.\p{Nd}+)?%?"), 0)).alias("pos", "number"))
    first = numbers.groupBy("doc_id", "number").agg(F.min(F.struct("claim_no", "pos")).alias("o"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("o"))).where(F.col("r") <= NUMBERS)
    rows = ranked.join(source_text(sources), "doc_id")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers"), F.count_if(~F.contains("source", "number")).alias("unsupported"))


def years_of(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(YEAR), 0)))


def check_years(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, result_years, source_years) of documents whose years are not all among their sources', where these have any; all years of the document and the first twenty of the sources, sorted."""
    rows = docs.join(source_text(sources), "doc_id").select("doc_id", years_of(F.col("text")).alias("result_years"), years_of(F.col("source")).alias("source_years"))
    return rows.where((F.size("source_years") > 0) & (F.size(F.array_except("result_years", "source_years")) > 0)).withColumn("source_years", F.slice("source_years", 1, 20))


#: Issues and what to do about each; N stands for a count.
ISSUES = {
    "no_sources": ("no documents to check against", "upload documents, or review by model or hybrid"), "no_model": ("no model to review with", "set up a review model"),
    "citations": ("claims with missing or invalid citations", "cite a source for every claim"), "entailment": ("N claims not supported by the sources", "tone down, or add closer sources"),
    "years": ("years that the sources do not have", "filter the sources by year and edition"), "numbers": ("N numbers not found in the sources", "check the numbers before use"),
    "unverified": ("no authoritative sources, so unverified", "upload sources for a strict review"),
}


def review_report(docs: DataFrame, sources: DataFrame, citations: DataFrame, entailed: DataFrame, numbers: DataFrame, years: DataFrame, model: DataFrame | None = None, mode: str = "hybrid", strict_with_sources: bool = True) -> DataFrame:
    """Per document (doc_id): (doc_id, strict, issues, suggestions, item_ids, passed), lists in order.

    Modes are ``llm_only``, ``document_only`` and ``hybrid``; a review is strict where documents count and the document
    has sources.  Citations, entailment and numbers count if strict, years wherever documents do.  ``model`` (doc_id,
    issues, suggestions) is what a model found; its issues come before the note that a result is unverified.  Repeated
    issues and suggestions count once.  An item's id is made of its place and a digest of issue, suggestion and place.
    """
    by_documents = mode in ("document_only", "hybrid")
    weak = entailed.groupBy("doc_id").agg(F.count_if(~F.col("entailed")).alias("weak"))
    having = sources.select("doc_id").distinct().withColumn("has_sources", F.lit(True))
    rows = docs.select("doc_id").join(having, "doc_id", "left").join(citations.select("doc_id", "missing", "invalid"), "doc_id", "left").join(weak, "doc_id", "left").join(numbers, "doc_id", "left").join(years, "doc_id", "left")
    texts = F.array().cast("array<string>")
    rows = rows.join(model.select("doc_id", F.col("issues").alias("m_issues"), F.col("suggestions").alias("m_suggestions")), "doc_id", "left") if model is not None else rows.withColumns({"m_issues": texts, "m_suggestions": texts})
    some, strict = F.coalesce("has_sources", F.lit(False)), F.lit(by_documents and strict_with_sources) & F.coalesce("has_sources", F.lit(False))
    n = lambda c: F.coalesce(c, F.lit(0))
    found = [
        ("no_sources", F.lit(mode == "document_only") & ~some, None), ("no_model", F.lit(mode == "llm_only" and model is None), None), ("citations", strict & (n("missing") + n("invalid") > 0), None),
        ("entailment", strict & (n("weak") > 0), "weak"), ("years", F.lit(by_documents) & F.col("result_years").isNotNull(), None), ("numbers", strict & (n("unsupported") > 0), "unsupported"),
    ]
    last = ("unverified", F.lit(mode == "hybrid") & ~strict & ~some, None)

    def text(kind: str, count: str | None, k: int) -> Column:
        return F.lit(ISSUES[kind][k]) if count is None or k else F.regexp_replace(F.lit(ISSUES[kind][k]), "^N", F.col(count).cast("string"))

    def listed(k: int, extra: str) -> Column:
        own = F.array_compact(F.array(*(F.when(cond, text(kind, count, k)) for kind, cond, count in found)))
        end = F.array_compact(F.array(F.when(last[1], text(last[0], None, k))))
        return F.array_distinct(F.filter(F.concat(own, F.coalesce(extra, texts), end), lambda x: F.trim(x) != ""))

    rows = rows.select("doc_id", strict.alias("strict"), listed(0, "m_issues").alias("issues"), listed(1, "m_suggestions").alias("suggestions"))
    digest = lambda x, i: F.sha1(F.encode(F.concat_ws("|", F.trim(x), F.trim(F.coalesce(F.get("suggestions", i), F.lit(""))), i.cast("string")), "UTF-8"))
    named = F.transform("issues", lambda x, i: F.concat(F.lit("ri_"), (i + 1).cast("string"), F.lit("_"), F.substring(digest(x, i), 1, 10)))
    return rows.select("doc_id", "strict", "issues", "suggestions", named.alias("item_ids"), (F.size("issues") == 0).alias("passed"))


#: Headings of the body, up to the end of their line, and of the sections that are not the body (fixed values).
BODY = r"(?m)^\s{0,3}#{1,6}\s*(?:正文|发布正文)[^\S\n]*$"
NOT_BODY = r"(?m)^\s{0,3}#{1,6}\s*(?:笔记标题(?:\s*5\s*个)?备选|标题(?:备选|建议)?|封面文案|轮播图逐页文案|轮播图|标签建议|评论区引导|评论引导)\s*$"
#: Punctuation that counts as equal in quotes (fixed values).
FOLDED = {
    "“": '"', "”": '"', "‘": "'", "’": "'", "（": "(", "）": ")", "：": ":", "，": ",", "；": ";", "。": ".", "、": ",", "＋": "+", "－": "-", "—": "-", "–": "-", "−": "-", "＝": "=", "·": ".", "…": "...",
}


def body_span(text: str) -> tuple[int, int]:
    """Where the body of a Markdown text lies: after its heading, up to the next section that is not the body; without that heading, all before the first such section."""
    head = re.search(BODY, text)
    start = min(head.end() + 1, len(text)) if head else 0  # after the heading's line end
    after = re.compile(NOT_BODY).search(text, start)
    return start, after.start() if after else len(text)


def _folded(text: str) -> tuple[str, list[int]]:
    """The text without white space and emphasis, punctuation and forms of letters made alike, and where each character came from."""
    out, at = [], []
    for i, c in enumerate(text):
        if not c.isspace() and c not in "*`_":
            for x in unicodedata.normalize("NFKC", FOLDED.get(c, c)):
                if not x.isspace():
                    out.append(x)
                    at.append(i)
    return "".join(out), at


def quote_spans(text: str, quote: str) -> list[tuple[int, int]]:
    """(start, length) of a quote: its first place as it is, else all places where it stands when both are folded."""
    if not text or not quote:
        return []
    k = text.find(quote)
    if k >= 0:
        return [(k, len(quote))]
    body, at = _folded(text)
    bare = _folded(quote)[0]
    spans: list[tuple[int, int]] = []
    k = body.find(bare) if bare else -1
    while k >= 0:
        span = at[k], at[k + len(bare) - 1] + 1 - at[k]
        if span not in spans:
            spans.append(span)
        k = body.find(bare, k + 1)
    return spans


def locate_quotes(docs: DataFrame, quotes: DataFrame, body_only: bool = False) -> DataFrame:
    """(doc_id, quote_no, hit, start, length): places of quotes (doc_id, quote_no, quote) in texts (doc_id, text), or in their bodies; a quote that stands nowhere has one row with start -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, no, text, quote in zip(pdf["doc_id"], pdf["quote_no"], pdf["text"], pdf["quote"]):
                a, b = body_span(text or "") if body_only else (0, len(text or ""))
                found = quote_spans((text or "")[a:b], quote or "")
                out += [(doc, no, k, a + s, n) for k, (s, n) in enumerate(found)] or [(doc, no, 0, -1, 0)]
            yield pd.DataFrame(out, columns=["doc_id", "quote_no", "hit", "start", "length"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").join(quotes, "doc_id").select("doc_id", "quote_no", "text", "quote").mapInPandas(run, f"doc_id {kind}, quote_no long, hit long, start long, length long")


def replace_quotes(docs: DataFrame, quotes: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, text, replaced): texts whose quotes (doc_id, quote_no, quote, replacement) are replaced in the body, in order of quote_no; the first place of each, or every.  A null text stays null."""
    changes = quotes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("quote_no", "quote", "replacement"))).alias("changes"))
    rows = docs.select("doc_id", "text").join(changes, "doc_id", "left").select("doc_id", "text", F.col("changes.quote").alias("quotes"), F.col("changes.replacement").alias("replacements"))

    def changed(text: str | None, quotes: list, replacements: list) -> tuple[str | None, int]:
        n = 0
        if text is None:
            return None, 0
        for quote, new in zip(quotes, replacements):
            a, b = body_span(text)
            body = text[a:b]
            spans = quote_spans(body, quote or "")
            for s, length in sorted(spans if every else spans[:1], reverse=True):
                body, n = body[:s] + (new or "") + body[s + length :], n + 1
            text = text[:a] + body + text[b:]
        return text, n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [changed(t, [] if q is None else list(q), [] if r is None else list(r)) for t, q, r in zip(pdf["text"], pdf["quotes"], pdf["replacements"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pd.Series([t for t, _ in done], dtype=object), "replaced": [n for _, n in done]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, text string, replaced long")


#: Vectors that meet a block of queries at a time; scores of pairs without one (null, below all) and of such that are no number (above all).
_STRIP, _NO_SCORE, _NAN = 1000, -2.0, 3.0


def _unit(vectors: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by their norms, and which have no score (null, of another length, or with null components)."""
    flat = vectors.flatten()
    if vectors.null_count or flat.null_count or len(flat) != len(vectors) * size or pc.any(pc.not_equal(pc.list_value_length(vectors), size)).as_py():
        rows = [v if v is not None and len(v) == size and None not in v else None for v in vectors.to_pylist()]
        made, bad = np.array([v or [1.0] * size for v in rows], "float64").reshape(-1, size), np.array([v is None for v in rows], bool)
    else:
        made, bad = flat.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size), np.zeros(len(vectors), bool)
    with np.errstate(all="ignore"):
        return made / np.sqrt((made * made).sum(axis=1, keepdims=True)), bad


def _best(pair: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query (``pair``), of equal scores the smaller id first."""
    order = np.lexsort((ids, -score, pair))
    pair, score, ids = pair[order], score[order], ids[order]
    place = np.arange(len(pair)) - np.searchsorted(pair, pair)
    return pair[place < k], score[place < k], ids[place < k]


def top_k_similar(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 5000) -> DataFrame:
    """The k most similar vectors (cosine, six digits) per query, by exact search: a stated query set against all rows.

    Queries reach the tasks in blocks of about ``block``, so what is broadcast has a fixed bound; more queries take more
    passes over the vectors.  A task multiplies its vectors with the block in strips and keeps the k best per query; these
    meet in the end.  A pair with a null in a vector has a null score.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").repartition(max(spark.sparkContext.defaultParallelism, 1))
    blocks = max(1, -(-queries.count() // block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = None
    for part in range(blocks):
        found = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == part).select(F.col("vec_id").cast("long"), "embedding").toArrow().combine_chunks()
        asked = spark.sparkContext.broadcast((found.column("vec_id").to_numpy(), found.column("embedding").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            ids, held = asked.value
            size = next((len(v) for v in held if v is not None), 0)
            q, none = _unit(pa.array(held, pa.list_(pa.float64())), size)
            best = np.zeros(0, "int64"), np.zeros(0), np.zeros(0, "int64")
            least = np.full(len(ids), -np.inf)
            strips = (b.slice(i, _STRIP) for b in batches for i in range(0, b.num_rows, _STRIP)) if len(ids) else ()
            for strip in strips:
                there = strip.column(0).to_numpy()
                v, bad = _unit(strip.column(1), size)
                with np.errstate(all="ignore"):
                    y = (q @ v.T) * 1e6
                    score = np.trunc(y + np.copysign(0.5, y)) / 1e6
                score[np.isnan(score)] = _NAN
                score[none], score[:, bad] = _NO_SCORE, _NO_SCORE
                score[ids[:, None] == there[None, :]] = -np.inf  # itself
                if len(there) > k:
                    least = np.maximum(least, np.partition(score, len(there) - k, axis=1)[:, len(there) - k])
                pair, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                best = _best(np.concatenate([best[0], pair]), np.concatenate([best[1], score[pair, at]]), np.concatenate([best[2], there[at]]), k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) == k)
                least[full] = np.maximum(least[full], best[1][np.searchsorted(best[0], full, "right") - 1])
            made = np.where(best[1] == _NAN, np.nan, best[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[2]), pa.array(made, mask=best[1] == _NO_SCORE)], ["query_id", "vec_id", "score"])

        scored = rows.mapInArrow(run, "query_id long, vec_id long, score double")
        best = scored.withColumn("place", rank.cast("long")).where(F.col("place") <= k)
        out = best if out is None else out.unionByName(best)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("query_id", "vec_id")})


#: Tags of every publication, forms of its titles, the mark of unverified texts, and how many points, tags and titles there are (fixed values).
COMMON_TAGS = ("备考", "考前冲刺", "小红书学习")
TITLES = ("{chapter}别再死记硬背：一篇理顺", "{topic}考前速记版，收藏就能背", "{point}，很多人第一遍都会错", "{subject}备考人必看：{chapter}核心笔记", "{topic}一图流复盘，考前快速过一遍")
NO_POINT, UNVERIFIED, PADDED = "高频考点", "> 未核验", "{title}备考重点 {k}"
POINTS, TAGS, N_TITLES, POINT_CHARS, SHORT = 8, 8, 5, 8, 22


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{00A0}\x{3000}]+", " "))


def _distinct(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, _one_line), lambda x: x != ""))


def body_text(text: Column) -> Column:
    """The body of a Markdown text, as :func:`body_span` has it."""
    after = F.when(text.rlike(BODY), F.regexp_replace(text, rf"(?s)^.*?{BODY}", "")).otherwise(text)
    return F.trim(F.regexp_replace(after, rf"(?s){NOT_BODY}.*$", ""), F.lit(" \t\n\r"))


def publish_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, body, points, tags, titles) of texts (doc_id, title, text, subject, category, chapter).

    The body has a heading; key points are its lines of at least eight characters without marks, distinct, eight at most;
    tags are subject, category, chapter and the common ones, without # and white space; five titles are made of them.
    """
    body = body_text(F.col("text"))
    rows = docs.withColumn("body", F.when(F.startswith(body, F.lit("#")), body).otherwise(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), body)))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s*", ""), r"^[ \-*|]+|[ \-*|]+$", "")
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: ~F.startswith(x, F.lit(UNVERIFIED)))
    points = F.slice(_distinct(F.filter(F.transform(lines, bare), lambda x: F.length(x) >= POINT_CHARS)), 1, POINTS)
    tags = F.slice(_distinct(F.transform(F.array("subject", "category", "chapter", *map(F.lit, COMMON_TAGS)), lambda x: F.regexp_replace(x, r"[#\s]+", ""))), 1, TAGS)
    rows = rows.withColumn("points", points).withColumn("tags", tags)
    kept = lambda c: F.nullif(F.col(c), F.lit(""))
    topic = F.coalesce(F.nullif(F.concat_ws(" · ", kept("subject"), kept("category"), kept("chapter")), F.lit("")), F.col("title"))
    first = _one_line(F.get("points", F.lit(0)))
    point = F.when(F.size("points") == 0, NO_POINT).otherwise(F.when(F.length(first) <= SHORT, first).otherwise(F.concat(F.substring(first, 1, SHORT), F.lit("..."))))
    values = {"chapter": F.coalesce(kept("chapter"), kept("category"), kept("subject"), F.lit("")), "topic": topic, "point": point, "subject": F.coalesce("subject", F.lit(""))}

    def filled(form: str) -> Column:
        return F.concat(*(values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", form) if p))

    made = F.slice(_distinct(F.array(*map(filled, TITLES))), 1, N_TITLES)
    more = F.transform(F.sequence(F.lit(1), F.lit(N_TITLES)), lambda k: F.concat("title", F.lit(PADDED.split("{title}")[1].split("{k}")[0]), k.cast("string")))
    titles = F.concat(made, F.slice(more, F.size(made) + 1, F.lit(N_TITLES) - F.size(made)))
    return rows.select("doc_id", "body", "points", "tags", titles.alias("titles"))
