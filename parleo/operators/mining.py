"""Phrase and term mining over corpora, correction discovery, training-set preparation."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parleo.functions import align
from parleo.functions.columns import explode_once, half_up, let, n_words, ngrams, norm, words
from parleo.plans.skew import dim, salted_join
from parleo.plans.stage import settle
from parleo.sources import seeds


def text_column(df: DataFrame, candidates: Sequence[str] = ("utterance", "text", "template", "sentence")) -> DataFrame:
    """First candidate that exists (else the first column) as ``text``."""
    have = [c for c in candidates if c in df.columns]
    src = have[0] if have else df.columns[0]
    return df if src == "text" else df.withColumn("text", F.col(src))


def phrase_counts(docs: DataFrame, label: str, sizes: Sequence[int] = (3, 4, 5)) -> DataFrame:
    """How often each word n-gram occurs under either label.

    One row per place is shuffled, not one per place and size: the longest
    n-gram that begins there, dealt by its first words (those of the smallest
    size).  Every shorter n-gram is the beginning of such rows, so all sizes
    are counted where the rows lie.
    """
    sizes = sorted(set(sizes))
    keys = [f"_k{j}" for j in range(len(sizes))]
    steps = list(zip(sizes[1:], sizes))

    def starting(t: Column, i: Column) -> Column:
        more = [F.when(F.size(t) >= i + n - 1, F.array_join(F.slice(t, i + m, n - m), " ")) for n, m in steps]
        return F.struct(F.array_join(F.slice(t, i, sizes[0]), " ").alias(keys[0]), *[c.alias(k) for c, k in zip(more, keys[1:])])

    places = let(words(F.lower("text")), lambda t: F.when(F.size(t) >= sizes[0], F.transform(F.sequence(F.lit(1), F.size(t) - sizes[0] + 1), lambda i: starting(t, i))))
    x = explode_once(docs.select(F.col(label).alias("y"), "text"), ["y"], places, "p").select("y", "p.*").repartition(keys[0])
    n = ["n_scam", "n_normal"]
    own = x.groupBy(*keys).agg(F.count_if(F.col("y") == 1).alias(n[0]), F.count_if(F.col("y") != 1).alias(n[1]))
    found, sums = [], {}
    for j in range(len(keys)):
        same, rest = keys[:j + 1], keys[j + 1:]
        if rest:
            w = Window.partitionBy(*same).orderBy(*rest)
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            sums |= {f"_f{j}": F.row_number().over(w) == 1} | {f"_{c}{j}": F.sum(c).over(whole) for c in n}
        counted = F.struct(F.concat_ws(" ", *same).alias("phrase"), *[F.col(f"_{c}{j}" if rest else c).alias(c) for c in n])
        found.append(F.when((F.col(f"_f{j}") if rest else F.lit(True)) & F.col(keys[j]).isNotNull(), counted))
    return own.withColumns(sums).select(F.inline(F.array_compact(F.array(*found)))) if sums else own.withColumnRenamed(keys[0], "phrase")


def over_represented(counts: DataFrame, sizes: DataFrame, categories: Sequence[tuple[str, str]], top: int | None = None) -> DataFrame:
    """Frequent phrases at least twice as common under the label, filed under the first matching category.

    ``sizes`` is one row with the number of documents per label.  ``top`` limits
    the phrases looked at, most frequent first; by default all are.
    """
    j = counts.where("n_scam > 0")
    j = (j.orderBy(F.desc("n_scam"), "phrase").limit(top) if top else j).withColumns({c: sizes.select(c).scalar() for c in ("scam_docs", "normal_docs")})
    min_n = F.greatest(F.lit(3).cast("bigint"), F.floor(F.col("scam_docs") / 100))
    ratio = (F.col("n_scam") / F.greatest(F.col("scam_docs"), F.lit(1))) / F.greatest(F.col("n_normal") / F.greatest(F.col("normal_docs"), F.lit(1)), F.lit(1e-4))
    toks = F.split("phrase", " ")
    parts = F.concat(ngrams(toks, 1), ngrams(toks, 2), ngrams(toks, 3))
    by: dict[str, list[str]] = {}
    for c, k in categories:
        by.setdefault(c, []).append(k)
    cat = None
    for c, ks in by.items():
        hit = F.arrays_overlap(parts, F.array(*[F.lit(k) for k in ks]))
        cat = F.when(hit, c) if cat is None else cat.when(hit, c)
    return j.where((F.col("n_scam") >= min_n) & (ratio >= 2.0)).select("phrase", "n_scam", "n_normal", half_up(ratio, 3).alias("ratio"), cat.alias("category")).where("category is not null")


GREETING_WORDS = ["hello", "hi", "hey", "good", "welcome", "namaste"]
GREETING_HI = ["नमस्ते", "नमस्कार", "प्रणाम", "हैलो", "हेलो"]


def short_phrases(turns: DataFrame, max_words: int = 5, max_words_hi: int = 3, min_hi: int = 2) -> DataFrame:
    """Whole short turns as vocabulary; Devanagari ones must be shorter and occur twice."""
    t = F.lower(F.trim("text"))
    n = n_words(F.col("text"))
    hi = F.col("text").rlike("[ऀ-ॿ]")
    x = turns.select(F.when(hi, "hi").otherwise("en").alias("lang"), F.when(hi, t).otherwise(F.regexp_replace(t, r"\.+$", "")).alias("phrase"), n.alias("n_w"), words(t).alias("toks")).where(
        (F.col("phrase") != "") & (F.col("n_w") <= F.when(hi, max_words_hi).otherwise(max_words)))
    greet = F.when(F.col("lang") == "en", F.arrays_overlap("toks", F.array(*[F.lit(w) for w in GREETING_WORDS]))).otherwise(
        F.exists(F.array(*[F.lit(w) for w in GREETING_HI]), lambda w: F.contains(F.col("phrase"), w)))
    g = x.withColumn("g", greet).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("n"), F.bool_or("g").alias("is_greeting"))
    return g.where((F.col("lang") == "en") | (F.col("n") >= min_hi))


def _report(counts: DataFrame, top: int | None) -> DataFrame:
    """The commonest terms where a report asks for so many, else all."""
    return counts.orderBy(F.desc("n"), "term").limit(top) if top else counts


def acronyms(docs: DataFrame, top: int | None = None, at_least: int = 2) -> DataFrame:
    """Occurrences of finance acronyms, upper case, most frequent first."""
    p = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{seeds.FINANCE_PATTERN})(?![\p{{L}}\p{{N}}_])"
    x = explode_once(docs, [], F.regexp_extract_all("text", F.lit(p), F.lit(0)), "m")
    return x.groupBy(F.upper("m").alias("term")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).transform(_report, top)


def document_frequency(docs: DataFrame, terms: Sequence[str], top: int | None = None) -> DataFrame:
    """Number of texts that contain a term."""
    hit = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("text"), t))
    return explode_once(docs, [], hit, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")).transform(_report, top)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _swap_places(heard: pd.Series, truth: pd.Series) -> pd.Series:
    """Places of one-to-one substitutions, the first text's in the high and the second's in the low 32 bits."""
    out = []
    for h, t in zip(heard, truth):
        number: dict[str, int] = {}
        a, b = ([number.setdefault(w, len(number)) for w in text.split(" ")] if isinstance(text, str) else [] for text in (h, t))
        out.append([i << 32 | j for i, j in align.swaps(a, b)])
    return pd.Series(out)


def aligned_pairs(pairs: DataFrame, ids: Sequence[str], with_truth_place: bool = False) -> DataFrame:
    """One-to-one substitutions of two texts of any lengths (``functions.align``).

    What lies between two words aligned as equal is a substitution where both
    texts have as many words there.  Texts are not shuffled; only places come
    back from the workers.  A null text has no substitutions.
    """
    x = pairs.select(*ids, norm(F.col("heard")).alias("_h"), norm(F.col("truth")).alias("_t"))
    x = x.withColumn("_p", _swap_places("_h", "_t")).withColumns({"_h": F.split("_h", " "), "_t": F.split("_t", " ")})
    i, j = (lambda p: F.shiftright(p, 32)), (lambda p: p.bitwiseAND(0xFFFFFFFF))
    found = F.transform("_p", lambda p: F.struct(i(p).alias("pos"), F.get("_h", i(p).cast("int")).alias("heard"), F.get("_t", j(p).cast("int")).alias("truth"), j(p).alias("truth_pos")))
    return explode_once(x, list(ids), found, "p").select(*ids, "p.pos", "p.heard", "p.truth", *(["p.truth_pos"] if with_truth_place else []))


def discover_corrections(mismatches: DataFrame, min_count: int = 3, top: int | None = None, max_similarity: float = 0.8) -> DataFrame:
    """Frequent mismatches: all that touch a finance term, and the clearly different ones (of the ``top`` commonest where given)."""
    c = settle(mismatches.groupBy("heard", "truth").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    fin = F.col("heard").isin(*seeds.FINANCE_TERMS) | F.col("truth").isin(*seeds.FINANCE_TERMS)
    best = F.max_by(F.struct("truth", "n"), F.struct(F.col("n"), F.col("truth")))
    f = c.where(fin).groupBy("heard").agg(best.alias("s")).select("heard", "s.truth", "s.n", F.lit("financial").alias("kind"))
    sim = 1 - F.levenshtein("heard", "truth") / F.greatest(F.length("heard"), F.length("truth"))
    g = (c.orderBy(F.desc("n"), "heard", "truth").limit(top) if top else c).where((F.length("heard") >= 3) & (F.length("truth") >= 3) & (sim < max_similarity))
    g = g.join(f.select("heard"), "heard", "left_anti").groupBy("heard").agg(best.alias("s")).select("heard", "s.truth", "s.n", F.lit("general").alias("kind"))
    return f.unionByName(g)


def overlay_dictionary(seed: DataFrame, found: DataFrame) -> DataFrame:
    """Seed corrections with discovered ones on top."""
    j = seed.withColumnRenamed("truth", "s").join(found.select("heard", F.col("truth").alias("d")), "heard", "full_outer")
    return j.select("heard", F.coalesce("d", "s").alias("truth"), F.when(F.col("d").isNotNull(), "discovered").otherwise("seed").alias("source"))


def remap_labels(rows: DataFrame, mapping: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a mapped label, and the ten commonest labels without mapping."""
    m, small = dim(mapping)
    spread = [c for c in rows.columns if c != label]
    mapped = rows.join(m, label) if small else salted_join(rows, m, [label], spread)
    missing = rows.join(m, label, "left_anti") if small else salted_join(rows, m, [label], spread, how="left_anti")
    return mapped, missing.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(10)


def class_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, weighted F1 and F1 of 'anything but class 0' from one confusion table."""
    conf = settle(rows.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n")))
    tp = conf.where("label = pred").select(F.col("label").alias("c"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("sup"))
    prd = conf.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("prd"))
    per = sup.join(prd, "c", "left").join(tp, "c", "left").fillna(0)
    f1 = F.when(F.col("prd") + F.col("sup") > 0, 2.0 * F.col("tp") / (F.col("prd") + F.col("sup"))).otherwise(0.0)
    a = per.agg(F.sum("tp").alias("ok"), F.sum("sup").alias("n"), F.sum(f1 * F.col("sup")).alias("wf"))
    pos, ppos = F.col("label") > 0, F.col("pred") > 0
    b = conf.agg(F.sum(F.when(pos & ppos, F.col("n")).otherwise(0)).alias("btp"), F.sum(F.when(pos != ppos, F.col("n")).otherwise(0)).alias("bwrong"))
    btp, bwrong = b.select("btp").scalar(), b.select("bwrong").scalar()
    return a.select(half_up(F.col("ok") / F.col("n"), 5).alias("accuracy"), half_up(F.col("wf") / F.col("n"), 5).alias("f1_weighted"),
                            half_up(2.0 * btp / (2 * btp + bwrong), 5).alias("entity_f1"))


def stratified_split(rows: DataFrame, label: str, id_col: str, share: float = 0.85, seed: int = 42) -> DataFrame:
    """Exact share of every label by hash order, without ordering a label in one task.

    A histogram of the hash finds the slice where the share ends; only rows of
    that slice are ranked.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("bigint")
    x = rows.withColumns({"_h": h, "_b": F.floor(h / (1 << 20))})
    hist = x.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(label)
    hist = hist.withColumns({"upto": F.sum("c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    need = F.floor(F.col("n") * share + 0.5)
    plan = hist.select(label, "_b", (need - (F.col("upto") - F.col("c"))).alias("left"), "c")  # rows still needed when the slice starts
    y = x.join(plan, [label, "_b"])
    edge = (F.col("left") > 0) & (F.col("left") < F.col("c"))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col))
    sure = y.where(~edge).withColumn("split", F.when(F.col("left") >= F.col("c"), "train").otherwise("test"))
    cut = y.where(edge).withColumn("split", F.when(rank <= F.col("left"), "train").otherwise("test"))
    return sure.unionByName(cut).drop("_h", "_b", "left", "c")


def regroup_tokens(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token rows back to sentences in order; a sentence is a bounded unit."""
    s = F.array_sort(F.collect_list(F.struct("pos", "token", "label")))
    g = tokens.where("token is not null").groupBy(*keys).agg(s.alias("s"))
    return g.select(*keys, F.array_join(F.transform("s", lambda x: x["token"]), " ").alias("tokens"), F.array_join(F.transform("s", lambda x: x["label"].cast("string")), " ").alias("labels"))


# Marks of a language in a folder name, in order of precedence.
FOLDER_LANGUAGES = {"EN": "en", "RU": "ru", "PL": "pl", "FR": "fr", "DE": "de", "ES": "es", "Portuguese": "pt"}


def from_folder(path: Column) -> tuple[Column, Column]:
    """Language, from a mark in brackets such as ``(FR set)`` or ``(FR)``, and call type from a folder name."""
    low = F.lower(path)
    lang = F.lit("")
    for mark, code in reversed(FOLDER_LANGUAGES.items()):
        lang = F.when(path.contains(f"({mark} ") | path.contains(f"({mark})"), code).otherwise(lang)
    ct = (F.when(low.contains("billing") | low.contains("account"), "collections").when(low.contains("sale"), "general")
          .when(low.contains("support") | low.contains("customer service"), "complaint").otherwise("general"))
    return F.when(lang == "", "en").otherwise(lang), ct


AUDIO_GLOB = "*.{mp3,wav,m4a,ogg,flac,wma,aac}"


def list_audio(spark, path: str) -> DataFrame:
    """Audio files below a folder with language and call type; contents are never read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", AUDIO_GLOB).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    lang, ct = from_folder(F.col("path"))
    return f.withColumns({"language": lang, "call_type": ct})


QUESTIONS = 1000  # at most so many questions travel to the vectors
PIVOTS = 16  # cells of the vector index; more of them cut deeper and cost more when vectors are filed
SLACK = 2e-6  # similarities are compared after rounding to six digits


def _matrix(col: pa.ListArray) -> np.ndarray:
    """Vectors of an Arrow column as rows of a matrix; null entries become NaN."""
    if len(pc.unique(pc.list_value_length(col))) > 1:
        raise ValueError("vectors of different lengths")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _chords(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows of x and the chords between their directions and the pivots.

    Unlike the cosine the chord obeys the triangle inequality.
    """
    with np.errstate(all="ignore"):
        n = np.sqrt((x * x).sum(axis=1))
        return n, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T) / n[:, None]))


def _filed(rows: DataFrame, col: str, pivots: np.ndarray, keep: Sequence[str], nearest: bool) -> DataFrame:
    """Rows with a direction: ``keep``, the vector, its length, and (cell, chord to its pivot) for the nearest or for every pivot."""
    def run(batches):
        for b in batches if len(pivots) else ():  # no pivot: no vector at all
            x = _matrix(b.column(col))
            n, d = _chords(x, pivots)
            ok = np.flatnonzero((n > 0) & np.isfinite(n))
            d = d[ok]
            cell = d.argmin(axis=1)[:, None] if nearest and len(ok) else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            reps = np.repeat(ok, cell.shape[1]) if len(ok) else ok
            out = b.take(pa.array(reps))
            yield pa.RecordBatch.from_arrays(
                [*[out.column(c) for c in keep], out.column(col), pa.array(n[reps]), pa.array(cell.ravel().astype(np.int32)),
                 pa.array(np.take_along_axis(d, cell, 1).ravel())], [*keep, col, "norm", "cell", "d"])
    schema = rows.schema
    kinds = T.StructType([schema[c] for c in (*keep, col)]).add("norm", "double").add("cell", "integer").add("d", "double")
    return rows.where(F.col(col).isNotNull() & F.col(keep[-1]).isNotNull()).select(*keep, col).mapInArrow(run, kinds)


def vector_index(vectors: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """Vectors (vec_id, embedding) filed under their nearest pivot with the distance to it, and the pivots.

    The pivots are directions of the ``pivots`` vectors with the smallest hash of
    their id; the choice bears on speed alone.  Vectors that are null, hold a null
    or a non-finite entry, or have length zero, have no direction and are left
    out; vectors of different lengths are an error.
    """
    some = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots)
    x = [np.array(r["embedding"], dtype=np.float64) for r in some.select("embedding").collect()]  # at most ``pivots`` rows
    p = [v / np.linalg.norm(v) for v in x if np.isfinite(np.linalg.norm(v)) and v.any()] or [np.eye(len(v))[0] for v in x[:1]]
    at = np.stack(p) if p else np.empty((0, 0))
    return settle(_filed(vectors, "embedding", at, ["vec_id"], nearest=True)), at


def top_similar(vectors: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most similar of all vectors per question (label, q_id, q) by cosine, ties to the smaller vec_id; exact.

    Up to ``QUESTIONS`` questions go to the vectors: one pass, a matrix product
    per batch, of which k rows per question stay.  More of them go through the index.
    Vectors and questions without a direction have no row.
    """
    few = questions.where("q_id is not null and q is not null").limit(QUESTIONS + 1).collect()
    if len(few) > QUESTIONS:
        return top_indexed(*vector_index(vectors), questions, k)
    asked = [(r["label"], r["q_id"], v, n) for r in few for v in [np.array(r["q"], dtype=np.float64)] for n in [np.linalg.norm(v)] if n > 0 and np.isfinite(n)]
    kinds = T.StructType([questions.schema["label"], questions.schema["q_id"], vectors.schema["vec_id"]]).add("sim", "double")
    names = kinds.names

    def best(batches):
        qs, qn = np.stack([v for _, _, v, _ in asked]), np.array([n for *_, n in asked])
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("embedding"))
            with np.errstate(all="ignore"):
                xn = np.sqrt((x * x).sum(axis=1))
                ids, x, xn = (z[(xn > 0) & np.isfinite(xn)] for z in (ids, x, xn))
                sims = np.floor((qs @ x.T) / (qn[:, None] * xn) * 1e6 + 0.5) / 1e6
            rows = []
            for (label, q_id, _, _), sim in zip(asked, sims):
                least = np.partition(sim, len(sim) - k - 1)[len(sim) - k - 1] if len(sim) > k + 1 else -np.inf  # one may be the question itself
                at = np.flatnonzero((sim >= least) & (ids != q_id))
                at = at[np.lexsort((ids[at], -sim[at]))[:k]]
                rows += [(label, q_id, i, s) for i, s in zip(ids[at].tolist(), sim[at].tolist())]
            yield from pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(kinds)).to_batches()

    if not asked:
        return questions.sparkSession.createDataFrame([], T.StructType(kinds.fields).add("rn", "long"))
    found = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").mapInArrow(best, kinds)
    w = Window.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id")
    return found.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= k)


def top_indexed(index: DataFrame, at: np.ndarray, questions: DataFrame, k: int = 5) -> DataFrame:
    """``top_similar`` for any number of questions over the index of ``vector_index``.

    A question first meets its own cell.  The k-th best there (or, in a small
    cell, the distance within which the cells hold enough vectors for certain)
    bounds how far a result can be; by the triangle inequality a cell, and a
    vector in it, whose distance to the pivot differs by more is left out.
    Vectors meet questions by an equi-join on the cell, and the per-task limit
    of row_number keeps what is shuffled to k rows per question and task.
    """
    cells = index.groupBy("cell").agg(F.max("d").alias("reach"), F.count(F.lit(1)).alias("n"))  # one row per pivot
    asked = _filed(questions, "q", at, ["label", "q_id"], nearest=False).withColumnsRenamed({"norm": "qn", "d": "qd"}).join(F.broadcast(cells), "cell")
    per = Window.partitionBy("q_id")
    far = F.col("qd") + F.col("reach")
    asked = asked.withColumn("sum_n", F.sum("n").over(per.orderBy(far, "cell")))  # one of them may be the question itself
    asked = settle(asked.withColumns({
        "sure": F.coalesce(F.min(F.when(F.col("sum_n") > k, far)).over(per), F.lit(2.0)), "turn": F.row_number().over(per.orderBy("qd", "cell"))}).drop("sum_n", "n"))
    home = _best_in(index, asked.where("turn = 1"), k)
    bound = home.groupBy("q_id").agg(F.count(F.lit(1)).alias("have"), F.min("sim").alias("kth"))
    seen = F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - 2.0 * (F.col("kth") - SLACK)))
    rest = asked.where("turn > 1").join(bound, "q_id", "left").withColumn(
        "sure", F.when(F.col("have") >= k, F.least("sure", seen)).otherwise(F.col("sure")))
    rest = rest.where(F.col("qd") - F.col("reach") <= F.col("sure") + SLACK).drop("have", "kth")
    both = home.unionByName(_best_in(index, rest, k))
    w = Window.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id")
    return both.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= k)


def _best_in(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of the cells that each question asks."""
    def cosines(batches):
        for b in batches:
            dots = np.einsum("ij,ij->i", _matrix(b.column("embedding")), _matrix(b.column("q"))) if b.num_rows else np.empty(0)
            cos = dots / (b.column("norm").to_numpy() * b.column("qn").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("q_id"), b.column("vec_id"), pa.array(cos)], ["label", "q_id", "vec_id", "sim"])
    j = index.join(asked, "cell").where((F.abs(F.col("d") - F.col("qd")) <= F.col("sure") + SLACK) & (F.col("vec_id") != F.col("q_id")))
    kinds = T.StructType([asked.schema["label"], asked.schema["q_id"], index.schema["vec_id"]]).add("sim", "double")
    j = j.select("label", "q_id", "vec_id", "embedding", "q", "norm", "qn").mapInArrow(cosines, kinds).withColumn("sim", half_up(F.col("sim"), 6))
    w = Window.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id")
    return j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
