"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with those of its language by
the Jensen-Shannon distance. The references are learned from all documents: character classes by summing, common words as
the ``COMMON`` most frequent words of a language among those with at least ``SHARE`` of its words. Such a word has that
share in one stretch of words at least, so the heavy words of all stretches are a complete list of candidates, and a second pass
counts them exactly. In languages with less than ``LANGUAGE`` of all words every word is counted, in a shuffle. Each language that
occurs has a reference of its own, of fixed size, and no document is compared with another language. Up to ``SENT`` references go to
the tasks; with more languages, those of small ones are a table that is joined by language.

The distance limits grow for short texts and small references, whose histograms are noisy, and under ``MIN_WORDS`` nothing is judged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm import text
from fieldspark.llm.doc_stats import class_totals, stats
from fieldspark.llm.store import keep, neutral

COMMON, SHARE, LANGUAGE, MIN_WORDS = 32, 2.0**-10, 2.0**-8, 50
SENT = 1 << 12  # references that go to the tasks
STRETCH = 1 << 18  # words of one language that a task sifts at once
CLASS_LIMIT, WORD_LIMIT, SHORT = 0.17, 0.35, 1.0
METRICS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "class_distance double, word_distance double"
)


@dataclass
class Reference:
    langs: list[str]
    classes: np.ndarray  # language x class, as shares
    words: list[np.ndarray]  # sorted word hashes of each language
    shares: list[np.ndarray]  # their shares, and that of all other words
    totals: list[int]  # words that each was learned from

    def add(self, lang: str, classes: list[int], common: list[tuple[int, int]], total: int) -> None:
        """A language by its class totals, its common words with their counts, and all its words."""
        keys, n = (np.array([c[k] for c in common], t) for k, t in ((0, np.int64), (1, float)))
        keys, order = keys.view(np.uint64), np.argsort(keys.view(np.uint64))
        self.langs.append(lang)
        self.classes = np.vstack([self.classes, np.array(classes) / max(1, sum(classes))])
        self.words.append(keys[order])
        self.shares.append(np.append(n[order], total - n.sum()) / max(1, total))
        self.totals.append(total)


def _none() -> Reference:
    return Reference([], np.zeros((0, 7)), [], [], [])


def _lang(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([x or "" for x in batch.column(1).to_pylist()], object)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = _lang(batch)
    for lang in dict.fromkeys(langs):
        yield lang, batch.column(2).filter(pa.array(langs == lang))


def learn(docs: DataFrame, lang_col: str, text_col: str) -> tuple[Reference, DataFrame | None]:
    """Two passes: class totals with candidate words, then exact counts. References to send, and a table of the others (``lang, ref``) if they are too many."""
    rows = docs.select(F.lit(None).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        totals: dict[str, int] = {}
        held: dict[str, list[np.ndarray]] = {}
        heavy: dict[str, set[int]] = {}

        def sift(lang: str) -> None:
            h, n = np.unique(np.concatenate(held[lang]), return_counts=True)
            heavy[lang].update(text.signed(h[n >= SHARE * n.sum()]).tolist())
            held[lang] = []

        for batch in batches:
            for lang, texts in _by_language(batch):
                for part in text.slices(texts):
                    h = text.words(part, lower=False).hash
                    classes[lang] = classes.get(lang, 0) + class_totals(part)
                    totals[lang] = totals.get(lang, 0) + len(h)
                    heavy.setdefault(lang, set())
                    # a full stretch is sifted when the next words come, so a short rest is sifted with it
                    if sum(map(len, held.setdefault(lang, []))) >= STRETCH:
                        sift(lang)
                    held[lang].append(h)
        for lang, total in totals.items():
            sift(lang)
            found = np.array(sorted(heavy[lang]), np.int64)
            yield pa.record_batch({"lang": pa.array([lang] * (len(found) + 8)), "kind": np.r_[np.arange(8), np.full(len(found), 8)].astype(np.int32), "key": np.r_[np.zeros(8, np.int64), found], "n": np.r_[classes[lang], total, np.zeros(len(found), np.int64)]})

    first = rows.mapInArrow(scan, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    first = keep(first, "candidates")
    spoken = first.where("kind = 7").select("lang", "n")
    total = spoken.agg(F.sum("n")).first()[0] or 0
    found = first.join(spoken.where(F.col("n") >= LANGUAGE * total).select("lang"), "lang").collect()
    langs = sorted({r["lang"] for r in found})
    classes = np.zeros((len(langs), 7))
    totals = dict.fromkeys(langs, 0)
    candidates = {lang: [] for lang in langs}
    for r in found:
        if r["kind"] < 7:
            classes[langs.index(r["lang"]), r["kind"]] = r["n"]
        elif r["kind"] == 7:
            totals[r["lang"]] = r["n"]
        else:
            candidates[r["lang"]].append(r["key"])
    sorted_keys = {lang: np.sort(np.array(k, np.int64).view(np.uint64)) for lang, k in candidates.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                keys = sorted_keys.get(lang)
                if keys is None or not len(keys):
                    continue
                for part in text.slices(texts):
                    h = text.words(part, lower=False).hash
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    sums[lang] = sums.get(lang, 0) + np.bincount(at[keys[at] == h], minlength=len(keys))
        for lang, n in sums.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(n)), "key": text.signed(sorted_keys[lang]), "n": n})

    exact = rows.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).collect()
    ref = _none()
    for lang, own_classes in zip(langs, classes, strict=True):
        own = sorted(((-r["n"], r["key"]) for r in exact if r["lang"] == lang and r["n"] >= SHARE * totals[lang]))[:COMMON]
        ref.add(lang, own_classes.tolist(), [(k, -c) for c, k in own], totals[lang])

    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_language(batch):
                for part in text.slices(texts):
                    h, n = np.unique(text.words(part, lower=False).hash, return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(h), pa.string()), "key": text.signed(h), "n": n})

    small = ~F.col("lang").isin(langs)
    spoken = spoken.where(small).select("lang", F.col("n").alias("total"))
    counted = rows.where(small).mapInArrow(count_all, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counted = counted.join(spoken, "lang").where(F.col("n") >= SHARE * F.col("total"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= COMMON)
    best = best.groupBy("lang").agg(F.collect_list(F.struct("key", "n")).alias("common"))
    shares = first.where(small & (F.col("kind") < 7)).groupBy("lang").agg(F.array(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in range(7)]).alias("classes"))
    rest = spoken.join(shares, "lang").join(best, "lang", "left").select("lang", F.struct("classes", F.coalesce("common", F.array().cast("array<struct<key:bigint,n:bigint>>")).alias("common"), "total").alias("ref"))
    rest = keep(rest, "references")
    if rest.count() > SENT:
        return ref, rest
    for r in rest.collect():
        ref.add(r["lang"], r["ref"]["classes"], r["ref"]["common"], r["ref"]["total"])
    return ref, None


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (the root of the divergence in bits) of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return np.sqrt(np.maximum(0.0, part.sum(axis=-1) / 2))


def judge(batch: pa.RecordBatch, ref: Reference) -> dict[str, np.ndarray]:
    """Metrics and verdict for the columns id, lang, text."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("reference_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")}
    langs = _lang(batch)
    place = {lang: k for k, lang in enumerate(ref.langs)}
    for part in text.slices(batch.column(2)):
        s = stats(part)
        own = np.array([place.get(x, -1) for x in langs[part.rows]])
        near = np.zeros((len(own), 2))  # a language without a reference is not judged
        chars, n = s.classes.sum(axis=1, keepdims=True), s.n_words[:, None]
        for k in np.unique(own[own >= 0]).tolist():
            keys = ref.words[k]
            counts = np.zeros((len(own), len(keys) + 1))
            if len(keys) and len(s.words.hash):
                at = np.minimum(np.searchsorted(keys, s.words.hash), len(keys) - 1)
                hit = keys[at] == s.words.hash
                counts[:, :-1] = np.bincount(s.words.doc[hit] * len(keys) + at[hit], minlength=len(own) * len(keys)).reshape(len(own), -1)
            counts[:, -1] = s.n_words - counts.sum(axis=1)
            both = np.stack([distance(s.classes / np.maximum(1, chars), ref.classes[k]), distance(counts / np.maximum(1, n), ref.shares[k])], axis=1)
            near[own == k] = both[own == k]
        learned = np.array([*ref.totals, 0])[own]
        for name, value in (("reference_words", learned), ("n_words", s.n_words), ("word_chars", s.word_chars), ("n_symbols", s.n_symbols), ("n_dup_lines", s.n_dup_lines), ("n_repeat_words", s.n_repeat_words), ("class_distance", near[:, 0]), ("word_distance", near[:, 1])):
            out[name].append(value)
    m = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
    slack = SHORT / np.sqrt(np.maximum(1, m["n_words"])) + SHORT / np.sqrt(np.maximum(1, m.pop("reference_words")))
    m["base_failed"] = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    far = (m["class_distance"] > CLASS_LIMIT + slack) | (m["word_distance"] > WORD_LIMIT + slack)
    m["kept"] = ~m["base_failed"] & ~(far & (m["n_words"] >= MIN_WORDS))
    return m


def _with_references(rows: DataFrame, lang_col: str, ref: Reference, rest: DataFrame | None, judged: Callable[[pa.RecordBatch, Reference], pa.RecordBatch], schema) -> DataFrame:
    """``judged`` over all rows with the references of their languages; small languages that are too many to send are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield judged(batch, ref)

    if rest is None:
        return rows.mapInArrow(run, schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, refs = _none(), batch.column(batch.num_columns - 1)
            batch = batch.select(list(range(batch.num_columns - 1)))
            langs = batch.column(batch.schema.get_field_index(lang_col)).cast(pa.string()).to_pylist()
            for lang, k in {x or "": k for k, x in enumerate(langs)}.items():
                r = refs[k].as_py()
                own.add(lang, r["classes"], [(c["key"], c["n"]) for c in r["common"]], r["total"])
            yield judged(batch, own)

    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))
    sent = lang.isin(ref.langs)
    table = rest.select(F.col("lang").alias("_lang"), F.col("ref").alias("_ref"))
    joined = rows.where(~sent).join(table, lang == F.col("_lang")).drop("_lang")
    return rows.where(sent).mapInArrow(run, schema).unionByName(joined.mapInArrow(run_joined, schema))


def quality(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", ref: Reference | None = None) -> DataFrame:
    """Metrics and verdict (``METRICS``) for every row of ``docs``.

    Null and empty texts have no words and fail the base rules. A null language counts as one without a name. Ids may be null
    or repeat; other columns are ignored; no rows give no rows.
    """
    ref, rest = (ref, None) if ref else learn(docs, lang_col, text_col)
    names = [c.split()[0] for c in METRICS.split(", ")]

    def judged(batch: pa.RecordBatch, ref: Reference) -> pa.RecordBatch:
        m = judge(batch, ref)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m[c]) for c in names[1:]]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return _with_references(rows, "lang", ref, rest, judged, METRICS)


def keep_good(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, in one pass after the references are learned.

    Null and empty texts fail the base rules and go; a null language counts as one without a name; equal rows are judged alike.
    Other columns may have any names.
    """
    names = docs.columns
    docs, (lang_col, text_col) = neutral(docs, lang_col, text_col)
    (ref, rest), columns = learn(docs, lang_col, text_col), docs.columns

    def judged(batch: pa.RecordBatch, ref: Reference) -> pa.RecordBatch:
        some = pa.RecordBatch.from_arrays([batch.column(0), batch.column(columns.index(lang_col)).cast(pa.string()), batch.column(columns.index(text_col)).cast(pa.string())], ["id", "lang", "text"])
        return batch.filter(pa.array(judge(some, ref)["kept"]))

    return _with_references(docs, lang_col, ref, rest, judged, docs.schema).toDF(*names)
