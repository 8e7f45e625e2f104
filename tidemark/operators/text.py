"""Text features of documents and filings."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts, styles or tags, blanks collapsed, lower case."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"&[#\w]+;", " ")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def table_rows(html: Column) -> Column:
    """Cells of each row of a page's tables, as arrays of text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))
    return F.transform(rows, cells)


def needs_translation(text: Column, lang: Column, home: str = "en", share: float = 0.08) -> Column:
    """Tagged with another language, or that share of its letters is not ASCII."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    foreign = F.length(F.regexp_replace(text, r"[^\p{L}]|[A-Za-z]", ""))
    return F.coalesce(lang != home, F.lit(False)) | F.coalesce(X.ratio(foreign, letters) >= share, F.lit(False))


#: Categories of risk and the words and phrases that mention them.
RISK_TERMS = {
    "litigation": ["litigation", "lawsuit", "legal proceeding", "settlement", "subpoena", "investigation"],
    "impairment": ["impairment", "write-down", "writedown", "goodwill impairment", "asset impairment"],
    "going_concern": ["going concern", "substantial doubt", "continue as a going concern"],
    "debt_covenant": ["debt covenant", "covenant compliance", "default", "cross-default", "credit agreement"],
    "liquidity": ["liquidity risk", "working capital", "cash flow constraints", "capital resources"],
    "cyber": ["cybersecurity", "cyber attack", "data breach", "ransomware"],
    "regulatory": ["regulatory", "sanctions", "tariff", "export control", "antitrust"],
    "ai_automation": ["artificial intelligence", "machine learning", "automation", "generative ai"],
}
#: Categories that are counted but are no part of the whole risk.
NO_RISK = ("ai_automation",)


def risk_features(docs: DataFrame, entity: str, order: str, text: str = "text", terms: dict[str, list[str]] | None = None) -> DataFrame:
    """Tokens, mentions of each category per 10,000 tokens, their sum as ``risk``, and ``worsening`` against the entity's document before.

    Words are counted as whole tokens, phrases wherever they stand. Worsening is not negative, and zero for a first document.
    """
    terms = RISK_TERMS if terms is None else terms
    # tokens two blanks apart, so that each has blanks of its own and a word is found by a plain search
    low = docs.withColumn("_low", F.lower(text)).withColumn("_apart", F.regexp_replace("_low", "[^a-z-]++", "  "))
    gaps = (F.octet_length("_apart") - F.octet_length(F.replace(F.col("_apart"), F.lit("  "), F.lit("")))) / 2
    outer = F.when(F.col("_apart").startswith("  "), 1).otherwise(0) + F.when(F.col("_apart").endswith("  "), 1).otherwise(0)
    out = low.withColumn("tokens", F.when(F.col("_apart") == "", 0).otherwise(gaps + 1 - outer).cast("int")).withColumn("_spaced", F.concat(F.lit(" "), "_apart", F.lit(" ")))

    def said(term: str) -> Column:
        place, sought = ("_low", term) if " " in term else ("_spaced", f" {term} ")
        less = F.octet_length(F.replace(F.col(place), F.lit(sought), F.lit("")))
        return F.when(F.col(place).contains(sought), (F.octet_length(place) - less) / len(sought.encode())).otherwise(F.lit(0.0))

    for name, listed in terms.items():
        out = out.withColumn(f"{name}_per_10k", X.ratio(sum((said(t) for t in listed), F.lit(0.0)) * 1e4, "tokens"))
    risk = sum(F.coalesce(F.col(f"{k}_per_10k"), F.lit(0.0)) for k in terms if k not in NO_RISK)
    out = out.drop("_low", "_apart", "_spaced").withColumn("risk", risk)
    return out.withColumn("worsening", F.coalesce(F.greatest(F.col("risk") - F.lag("risk").over(X.by(entity, order)), F.lit(0.0)), F.lit(0.0)))


def similarity_to_prior(docs: DataFrame, entity: str, order: str, text: str = "text") -> DataFrame:
    """Cosine of word counts with the entity's document before; the words meet by join."""
    w = X.by(entity, order)
    known = docs.select(entity, order, text).withColumn("prior", F.lag(order).over(w))
    words = known.select(order, F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")).alias("word")).groupBy(order, "word").agg(F.count("*").alias("n"))
    norms = words.groupBy(order).agg(F.sqrt(F.sum(F.pow("n", 2))).alias("norm"))
    a = known.where("prior is not null").select(order, "prior")
    dot = a.join(words, order).join(words.select(F.col(order).alias("prior"), "word", F.col("n").alias("m")), ["prior", "word"]).groupBy(order, "prior").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    out = a.join(dot, [order, "prior"], "left").join(norms, order, "left").join(norms.select(F.col(order).alias("prior"), F.col("norm").alias("prior_norm")), "prior", "left")
    return out.select(order, "prior", X.ratio(F.coalesce("dot", F.lit(0)), F.col("norm") * F.col("prior_norm")).alias("similarity"))


#: Questions and passages of a block; cells of scores that a task holds at once, columns of them of which one maximum is taken, and the share of passages beyond which a term is a column of a matrix.
QUESTIONS, PASSAGES, CELLS, SPAN, COMMON = 3 << 14, 1 << 13, 1 << 20, 64, 0.05


def _rows(group: pa.Table, kind: str, key: str | None = None) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A group's rows of one kind, with a ``key`` if one is named; of each of their terms the row, the hash and the weight."""
    rows = group.filter(pc.equal(group.column("kind"), kind))
    rows = rows.filter(pc.is_valid(rows.column(key))) if key else rows
    terms, weights = (rows.column(c).combine_chunks() for c in ("terms", "weights"))
    return rows, np.repeat(np.arange(rows.num_rows), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy(), weights.flatten().to_numpy()


def _nearest(k: int, ask: str, key: str):
    """Of a block of questions and one of passages: the ``k`` best passages of each question, and those that rounding could put among them."""

    def run(_: tuple, group: pa.Table) -> pa.Table:
        (q, q_row, q_term, q_weight), (p, p_row, p_term, p_weight) = _rows(group, "q"), _rows(group, "p", key)
        n, norm = p.num_rows, p.column("norm").to_numpy()
        own = np.unique(q_term)
        q_at, p_at = np.searchsorted(own, q_term), np.searchsorted(own, p_term)
        met = np.flatnonzero(own[np.minimum(p_at, len(own) - 1)] == p_term) if len(own) else np.zeros(0, np.int64)
        met = met[np.argsort(p_at[met], kind="stable")]
        p_at, p_row, p_weight = p_at[met], p_row[met], p_weight[met]
        many = np.bincount(p_at, minlength=len(own))
        # common terms by a product of matrices, the others one by one
        common = many > COMMON * n
        column = np.cumsum(common) - 1
        matrix, told = np.zeros((n, common.sum())), common[p_at]
        matrix[p_row[told], column[p_at[told]]] = p_weight[told]
        first = np.cumsum(many) - many
        place = np.empty(n, np.int64)
        place[np.argsort(p.column(key).to_numpy(), kind="stable")] = np.arange(n)
        step, found = max(1, CELLS // max(n, 1)), []
        for a in range(0, q.num_rows if n else 0, step):
            e = min(a + step, q.num_rows)
            some = slice(*np.searchsorted(q_row, [a, e]))
            row, at, weight = q_row[some] - a, q_at[some], q_weight[some]
            asked, told = np.zeros((e - a, matrix.shape[1])), common[at]
            asked[row[told], column[at[told]]] = weight[told]
            row, at, weight = row[~told], at[~told], weight[~told]
            each = np.repeat(np.arange(len(row)), many[at])
            other = first[at][each] + np.arange(len(each)) - (np.cumsum(many[at]) - many[at])[each]
            score = asked @ matrix.T + np.bincount(row[each] * n + p_row[other], weight[each] * p_weight[other], (e - a) * n).reshape(e - a, n)
            score /= norm
            spans = n // SPAN
            # k spans have a score of the k-th best maximum or more
            least = np.partition(score[:, : spans * SPAN].reshape(e - a, spans, SPAN).max(axis=2), spans - k, axis=1)[:, spans - k] if spans >= k else np.zeros(e - a)
            i, j = np.nonzero((score >= least[:, None] - 2e-9) & (score > 0))
            value = score[i, j]
            order = np.lexsort((place[j], -value, i))
            i, j, value = i[order], j[order], value[order]
            start = np.flatnonzero(np.diff(i, prepend=-1))
            size = np.diff(start, append=len(i))
            # of equal scores, the k smallest keys; of others, what rounds to no less than the k-th best
            ties = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(value, prepend=0) != 0))
            nth = np.arange(len(i)) - np.repeat(ties, np.diff(ties, append=len(i)))
            left = (nth < k) & (value >= np.repeat(value[start + np.minimum(size, k) - 1], size) - 2e-9)
            found.append((i[left] + a, j[left], value[left]))
        i, j, value = (np.concatenate([x[c] for x in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
        return pa.table({ask: q.column(ask).take(pa.array(i)), key: p.column(key).take(pa.array(j)), "score": value})

    return run


def retrieve(passages: DataFrame, questions: DataFrame, k: int = 6, key: str = "id", ask: str = "q", text: str = "text") -> DataFrame:
    """The ``k`` best passages of each question by tf-idf over words and word pairs.

    A question meets every passage that shares a term with it, common terms included: blocks of
    questions stand beside blocks of passages, whose scores stay in the task but for the ``k`` best of each question.
    """

    def terms(df: DataFrame, id_: str) -> DataFrame:
        t = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        # texts are shuffled by key, which is less than their terms would be
        own = df.select(id_, text).repartition(id_).select(id_, t.alias("t"))
        own = own.withColumn("t", F.concat("t", F.when(F.size("t") > 1, F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))))
        return own.select(id_, F.explode("t").alias("term")).groupBy(id_, "term").agg(F.count("*").alias("n"))

    own, said = terms(passages, key), terms(questions, ask)
    # all passages count, those without a key or a term too
    total, asked = passages.count(), questions.count()
    idf = (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")
    df = own.groupBy("term").agg(F.count("*").alias("df")).select("term", idf)
    known = df.join(said.select("term").distinct().withColumn("told", F.lit(True)), "term", "left")
    q_deals, p_deals = (max(1, -(-a // b)) for a, b in ((asked, QUESTIONS), (total, PASSAGES)))
    deal = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))

    def packed(df: DataFrame, id_: str, kind: str, weight: Column, when: Column, *more: Column) -> DataFrame:
        """A row of each key, with its terms' hashes and weights."""
        x = df.groupBy(id_).agg(F.collect_list(F.when(when, F.struct(F.xxhash64("term").alias("term"), weight.cast("double").alias("w")))).alias("x"), *more)
        return x.select("*", F.lit(kind).alias("kind"), F.col("x.term").alias("terms"), F.col("x.w").alias("weights")).drop("x")

    # idf counts on both sides
    q = packed(said.join(df, "term"), ask, "q", F.col("n") * F.col("idf") * F.col("idf"), F.lit(True))
    p = packed(own.join(known, "term"), key, "p", F.col("n"), F.col("told"), F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), 2))).alias("norm"))
    q = q.withColumn("q_deal", deal(ask, q_deals)).withColumn("p_deal", each(p_deals))
    p = p.withColumn("p_deal", deal(key, p_deals)).withColumn("q_deal", each(q_deals))
    kinds = dict(questions.dtypes)[ask], dict(passages.dtypes)[key]
    scored = q.unionByName(p, allowMissingColumns=True).groupBy("q_deal", "p_deal").applyInArrow(_nearest(k, ask, key), f"{ask} {kinds[0]}, {key} {kinds[1]}, score double")
    scored = scored.withColumn("score", F.round("score", 9))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(ask).orderBy(F.desc("score"), key))).where(F.col("rank") <= k).select(ask, key, "score", "rank")


def chunks(docs: DataFrame, key: str, text: str = "text", size: int = 1200) -> DataFrame:
    """Paragraphs packed in order into chunks of at most ``size`` characters (a longer one stands alone)."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        fits = (a["open"] == "") | (F.length(a["open"]) + 1 + F.length(p) <= size)
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(a["open"] == "", p).when(fits, F.concat(a["open"], F.lit("\n"), p)).otherwise(p).alias("open"))

    parts = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    packed = F.aggregate(parts, zero, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return docs.select(key, F.posexplode(packed).alias("chunk", "text"))


def countries(docs: DataFrame, aliases: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Countries named in the first of ``fields`` that names any, as a sorted array, with the field as confidence tier."""
    pattern = F.concat(F.lit(r"(?i)(?<![\p{L}])"), F.col("alias"), F.lit(r"(?![\p{L}])"))
    listed = aliases.agg(F.collect_list(F.struct(pattern.alias("pattern"), "country")).alias("_aliases"))  # one row: a table of aliases
    named = lambda f: F.array_sort(F.array_distinct(F.transform(F.filter("_aliases", lambda a: F.coalesce(F.regexp_like(F.col(f), a["pattern"]), F.lit(False))), lambda a: a["country"])))
    found = docs.select(key, *fields).crossJoin(F.broadcast(listed)).select(key, *[named(f).alias(f) for f in fields])
    tier = F.coalesce(*[F.when(F.size(f) > 0, F.struct(F.lit(f).alias("tier"), F.col(f).alias("countries"))) for f in fields])
    return found.withColumn("t", tier).select(key, F.col("t.tier").alias("tier"), F.col("t.countries").alias("countries"))


#: Confidence of a text's first country and of each, and the most there can be; and of the source alone.
TIERS = {"title": (0.75, 0.08, 0.95), "query": (0.55, 0.07, 0.80)}
SOURCE_CONFIDENCE = 0.35
UNNAMED = ("global", "unknown", "none", "nan", "")


def event_countries(docs: DataFrame, aliases: DataFrame, key: str, title: str = "title", query: str = "query", source: str = "source", most_aliases: int = 20_000) -> DataFrame:
    """``key, countries, method, confidence``: countries named in the title, else in the query, else that of the source, by a table of ``alias, country``.

    Aliases are plain texts in any case, and no letter may stand before or after one. All
    are one pattern, the longest first, built in the driver from at most ``most_aliases`` rows, so a text is
    read once however many there are, and only what was found meets the table. A source that is no
    alias stands for itself; a source of ``UNNAMED`` for nothing.
    """
    listed = [r[0] for r in aliases.select(F.lower("alias")).distinct().limit(most_aliases + 1).collect()]
    if len(listed) > most_aliases:
        raise ValueError(f"more than {most_aliases} aliases")
    sorted_ = sorted((a for a in listed if a), key=lambda a: (-len(a), a))
    literal = "|".join(re.sub(r"([^\w\s])", r"\\\1", a) for a in sorted_) or r"(?!)"
    pattern = F.lit(rf"(?iu)(?<![\p{{L}}])(?:{literal})(?![\p{{L}}])")
    table = aliases.select(F.lower("alias").alias("alias"), "country").distinct()
    texts = docs.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("said")) for n, c in (("title", title), ("query", query))])).alias("t")).select(key, "t.*")
    found = texts.select(key, "method", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("said", pattern, F.lit(0)), F.lower))).alias("alias"))
    named = found.join(table, "alias").groupBy(key, "method").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    best = named.groupBy(key).agg(F.max_by(F.struct("method", "countries"), F.col("method") == "title").alias("b"))
    plain = F.trim(F.col(source).cast("string"))
    own = docs.select(key, F.when(~F.lower(plain).isin(*UNNAMED), plain).alias("_source"), F.lower(plain).alias("alias")).join(table.groupBy("alias").agg(F.min("country").alias("_canonical")), "alias", "left")
    x = own.join(best, key, "left")
    many = F.size("b.countries").cast("double")
    sure = F.coalesce(*[F.when(F.col("b.method") == n, F.least(F.lit(most), first + each * many)) for n, (first, each, most) in TIERS.items()])
    home = F.coalesce("_canonical", "_source")
    return x.select(
        key, F.coalesce("b.countries", F.when(home.isNotNull(), F.array(home)), F.array().cast("array<string>")).alias("countries"),
        F.coalesce(F.concat("b.method", F.lit("_text")), F.when(home.isNotNull(), "source"), F.lit("unresolved")).alias("method"), F.coalesce(sure, F.when(home.isNotNull(), SOURCE_CONFIDENCE), F.lit(0.0)).alias("confidence"),
    )
