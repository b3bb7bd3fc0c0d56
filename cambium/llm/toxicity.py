"""Toxicity by a word classifier that is trained to ignore which group a text mentions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, crc_fold, free_name, least_hashed, one_row_each, stored, tagged, text_slices, word_bounds, word_hashes

BITS = 18
#: Bound of the labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 12_000
#: Standard errors by which a word's share must differ between the labels.
LEAST_Z = 4.0
#: Identity terms by language and kind; a term is swapped for the next of its kind. A parameter of every function here.
IDENTITY_TERMS = {
    "en": [
        ["women", "men"],
        ["woman", "man"],
        ["girls", "boys"],
        ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
        ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
        ["black", "white", "asian", "latino", "african", "arab"],
        ["gay", "straight", "lesbian", "bisexual", "transgender", "queer"],
        ["immigrants", "natives", "refugees", "foreigners"],
        ["disabled", "deaf", "blind", "autistic"],
        ["old", "young", "elderly"],
    ],
    "de": [
        ["frauen", "männer"],
        ["frau", "mann"],
        ["mädchen", "jungen"],
        ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"],
        ["christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"],
        ["schwarze", "weiße", "asiaten", "afrikaner", "araber"],
        ["schwul", "heterosexuell", "lesbisch", "bisexuell", "transsexuell"],
        ["einwanderer", "einheimische", "flüchtlinge", "ausländer"],
        ["behindert", "gehörlos", "blind", "autistisch"],
    ],
    "fr": [
        ["femmes", "hommes"],
        ["femme", "homme"],
        ["filles", "garçons"],
        ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"],
        ["chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"],
        ["noirs", "blancs", "asiatiques", "africains", "arabes"],
        ["gay", "hétérosexuel", "lesbienne", "bisexuel", "transgenre"],
        ["immigrés", "autochtones", "réfugiés", "étrangers"],
        ["handicapé", "sourd", "aveugle", "autiste"],
    ],
    "es": [
        ["mujeres", "hombres"],
        ["mujer", "hombre"],
        ["chicas", "chicos"],
        ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"],
        ["cristiano", "musulmán", "judío", "hindú", "budista", "ateo"],
        ["negros", "blancos", "asiáticos", "africanos", "árabes"],
        ["gay", "heterosexual", "lesbiana", "bisexual", "transgénero"],
        ["inmigrantes", "nativos", "refugiados", "extranjeros"],
        ["discapacitado", "sordo", "ciego", "autista"],
    ],
}
#: Bytes of words: letters, digits and what is not ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(r) for r in raw]), ends)


class Terms:
    """Identity terms with places of their own: another word that falls into a term's bucket gets a place past the buckets.

    A word of several languages or kinds counts where it is listed first.
    """

    def __init__(self, by_language: dict[str, list[list[str]]]):
        kinds = [kind for lists in by_language.values() for kind in lists]
        words = list(dict.fromkeys(w for kind in kinds for w in kind))
        hashes = _hash_words(words) if words else np.zeros(0, U64)
        self.hashes = np.sort(hashes)
        self.buckets = np.unique(hashes >> U64(64 - BITS)).astype(np.int64)
        self.places = (1 << BITS) + len(self.buckets)
        place = dict(zip(words, (hashes >> U64(64 - BITS)).astype(int).tolist(), strict=True))
        self.swap: dict[int, int] = {}
        for kind in kinds:
            for word, other in zip(kind, [*kind[1:], kind[0]], strict=True):
                if place[word] != place[other]:
                    self.swap.setdefault(place[word], place[other])

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, by its hash."""
        bucket = (hashes >> U64(64 - BITS)).astype(np.int64)
        if not len(self.buckets):
            return bucket
        at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        term = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes
        return np.where((self.buckets[at] == bucket) & ~term, (1 << BITS) + at, bucket)


TERMS = Terms(IDENTITY_TERMS)


def word_sets(data: np.ndarray, offsets: np.ndarray, terms: Terms = TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct words of each document and their offsets."""
    starts, ends, doc = word_bounds(INSIDE[data], offsets)
    key = np.unique(doc.astype(np.uint64) << U64(BITS + 1) | terms.place(word_hashes(LOWER[data], starts, ends)).astype(U64))
    cuts = np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << U64(BITS + 1))
    return (key & U64((2 << BITS) - 1)).astype(np.int64), cuts


def telling_words(seen: np.ndarray, seen_toxic: np.ndarray, n: int, toxic: float, terms: Terms) -> np.ndarray:
    """Which words differ in share between the labels by LEAST_Z standard errors, and the identity terms."""
    share = seen / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / toxic + 1 / (n - toxic)))
    telling = (seen >= 3) & (np.abs(seen_toxic / toxic - (seen - seen_toxic) / (n - toxic)) >= LEAST_Z * error)
    telling[list(terms.swap)] = True
    return telling


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, buckets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[buckets])))
        return 1 / (1 + np.exp(-np.clip(self.bias + total[cuts[1:]] - total[cuts[:-1]], -30, 30)))


def fit_weights(rows: list[np.ndarray], toxic: np.ndarray, penalty: float = 1.0, ridge: float = 0.05, steps: int = 250, terms: Terms = TERMS) -> Model:
    """Logistic regression on word presence, with a penalty on score changes under identity swaps.

    Loss: the mean over rows of log loss, plus `penalty` times the squared change of the logit
    when the row's identity terms are swapped, plus ridge / rows times the squared weights.
    Only words whose share among toxic rows differs from that among the others by LEAST_Z
    standard errors are used, and the identity terms; so chance words of a small sample don't
    count. A toxic row weighs the square root of the number of clean rows for each, so
    that rare toxic rows aren't given up for the many clean ones. Full-batch Adam from zero, so the result depends on nothing else.
    """
    n = len(rows)
    weights = np.zeros(terms.places)
    if not n or toxic.min() == toxic.max():
        share = float(toxic.mean()) if n else 0.0
        return Model(weights, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    swap = terms.swap
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    n1 = toxic.sum()
    telling = telling_words(np.bincount(flat, minlength=terms.places), np.bincount(flat, toxic[owner], terms.places), n, n1, terms)
    flat, owner = flat[telling[flat]], owner[telling[flat]]
    used, flat = np.unique(np.concatenate((flat, np.array(sorted(swap), np.int64))), return_inverse=True)
    flat = flat[: len(owner)]
    place = {int(b): i for i, b in enumerate(used)}
    to = np.arange(len(used))
    for a, b in swap.items():
        to[place[a]] = place[b]
    moved = to[flat] != flat
    plus, minus, moved_row = to[flat[moved]], flat[moved], owner[moved]
    weight = np.where(toxic > 0, np.sqrt((n - n1) / n1), 1.0)
    w, bias = np.zeros(len(used)), 0.0
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        logit = bias + np.bincount(owner, w[flat], n)
        wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic) * weight / n
        change = np.bincount(moved_row, w[plus] - w[minus], n) * (2 * penalty / n)
        grad = np.bincount(flat, wrong[owner], len(used)) + 2 * ridge / n * w
        grad += np.bincount(plus, change[moved_row], len(used)) - np.bincount(minus, change[moved_row], len(used))
        grad = np.append(grad, wrong.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights[used] = w
    return Model(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, penalty: float = 1.0, terms: Terms = TERMS) -> Model:
    """Fits on sample_rows labelled documents at most, those with the least hashes of their doc_id.

    Of several texts of one doc_id the one with the least hash is taken. Words are counted and chosen
    where the texts are, so the driver gets a count for each place and the telling words of each row only.
    """
    known = labels.filter(F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), 5) != 0)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    picked = F.broadcast(least_hashed(known, "doc_id", None, sample_rows))  # sample_rows bounds it
    chosen = F.broadcast(known.join(picked, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches):
            words, cuts = word_sets(data, offsets, terms)
            lists = [words[lo:hi].astype(np.int32) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            kept_ = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "toxic", "h", "at")]
            yield pa.RecordBatch.from_arrays([*kept_, pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "toxic", "h", "at", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    matched = tagged(docs.select("doc_id", "text").join(chosen, "doc_id"))
    every = stored(matched.mapInArrow(sets, f"doc_id {kind}, toxic int, h long, at long, words array<int>"))
    labelled = stored(one_row_each(every, ["doc_id"]).select("doc_id", "toxic", "words"))
    sizes = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    telling = np.ones(terms.places, bool)
    if 0 < sizes["toxic"] < sizes["n"]:
        counts = labelled.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).toPandas()  # a row a place at most
        seen, seen_toxic = np.zeros(terms.places), np.zeros(terms.places)
        seen[counts["word"]], seen_toxic[counts["word"]] = counts["n"], counts["toxic"]
        telling = telling_words(seen, seen_toxic, sizes["n"], sizes["toxic"], terms)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = [x[telling[x]] for x in part.column(2).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "toxic", "words"])

    got = labelled.mapInArrow(kept, labelled.schema).toPandas().sort_values("doc_id")
    return fit_weights([np.asarray(x, np.int64) for x in got["words"]], got["toxic"].to_numpy(float), penalty, terms=terms)


def score(docs: DataFrame, model: Model, carry: list[str], terms: Terms = TERMS) -> DataFrame:
    """The columns of `carry`, score and predicted for every row of docs; null text: no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights
    text = free_name("__text", carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text_slices(batches, text):
            got = shared.value.scores(*word_sets(data, offsets, terms))
            kept = [part.column(part.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[*carry, "score", "predicted"])

    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, F.col("text").alias(text)).mapInArrow(run, f"{head}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, terms: Terms = TERMS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from the labels whose fold (crc32 of doc_id, of 5) is not 0; held_out marks fold 0.
    Labels of a doc_id that disagree count as toxic. Null and empty texts get the score of no
    words. Null doc_ids: not held out and not learned from. Without labels of both sorts every
    score is the share of toxic ones. A very long text is read whole, as a run of its own. Repeated
    rows stay and get equal scores; other columns are ignored. Empty input: no rows.

    terms: the identity terms whose swaps the fit penalises. A table without any of them is scored by the
    same fit with nothing to penalise.
    """
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs.select("doc_id", "text", held_out.alias("held_out")), fit(docs, labels, terms=terms), ["doc_id", "held_out"], terms)
