"""Subject areas of documents, by factoring the document-term matrix with seeded non-negative alternating updates.

Terms are hashed into a fixed number of slots, so every term of every text counts and the model has the same size for any
corpus. There is one component per subject, anchored in a bounded sample of labelled documents, and one background
component per language label; the mixture of a document has weights on the subjects and on the background of its language.
Updates alternate between mixtures and components: a round goes once over all documents, takes each mixture on from where
the round before left it, and adds the components up in a tree. The fitted mixture of a document splits the terms of its
sentences over the components, which says what each sentence, the document and the corpus deal with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from ..operators.blocks import map_blocks
from ..runtime import materialize, release
from .words import fold, visible

#: Labelled rows that anchor the components, at most (the sample is by hash of the document).
LABEL_ROWS = 50_000
#: Slots of the terms; terms that share a slot count as one.
SLOTS = 1 << 18
#: Letters of a word that make its term, so that inflected forms, and cognates of other languages, count as one.
STEM = 6
#: Background components: one for each of the commonest language labels, the last for all other and missing labels.
BACKGROUNDS = 16
#: Alternating updates, and updates of a document's mixture in each.
ROUNDS, INNER = 6, 3
#: Weight of the anchors in the components of each round, words of the background that smooth an anchor, and how many
#: times as frequent as in the background a term of it is at least.
ANCHOR, SMOOTH, LIFT = 0.1, 50, 1.2
#: Words that each part of a mixture has beforehand, so that a subject is not lost where a document has few words of it.
PRIOR = 0.3
#: Different terms of a sentence that the mixture gives to a subject, at least, where the sentence deals with it: one is too few.
EVIDENCE = 1.75
#: Share of a document's sentences on subjects from which it deals with a subject.
SHARE = 0.25

_END = re.compile(r"[.!?…][\"”»')\]]*\s+(?=[^a-z\s])|\n\s*\n|\r?\n(?==)")
_WORD = re.compile(r"[^\W\d_]+")
#: Thai, kana, Han and Hangul letters.
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, as they are written. A line break ends no sentence unless a line is empty."""
    if not text:
        return []
    return [w for s in _END.split(visible(text)) if s and (w := _WORD.findall(s))]


def terms_of(word: str) -> list[str]:
    """The terms of a word: its stem; of letters written without blanks between words, all pairs of neighbours."""
    word = fold(word)
    if len(word) > 2 and _UNSPACED.search(word):
        return [word[i : i + 2] for i in range(len(word) - 1)]
    return [word[:STEM]]


class Slots:
    """Terms of words as slots of the model; each spelling is folded and hashed once."""

    def __init__(self, keep: int = 500_000) -> None:
        self.known: dict[str, list[int]] = {}
        self.keep = keep

    def __call__(self, words: list[str]) -> list[int]:
        known, out = self.known, []
        for w in words:
            n = known.get(w)
            if n is None:
                n = [xxh32_intdigest(t) % SLOTS for t in terms_of(w)]
                if len(known) < self.keep:
                    known[w] = n
            out += n
        return out


def _packed(ends: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """Numbers of each row as bytes: those before ``ends`` of it. Bytes pass between the JVM and Python as they are."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _by(of: np.ndarray, values: np.ndarray, size: int) -> pa.BinaryArray:
    """``values`` by their owners ``of``, which ascend."""
    return _packed(np.searchsorted(of, np.arange(size), side="right"), values.astype(np.int32))


def unpacked(batch: pa.RecordBatch, name: str, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed numbers, and how many each row has."""
    column = batch.column(name)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, kind, offsets[-1]) if data is not None and offsets[-1] else np.empty(0, kind)
    return values[offsets[0] :], np.diff(offsets)


_ENCODED = "doc_id bigint, label string, terms binary, counts binary, inside binary, ends binary"


def encoded(documents: DataFrame) -> DataFrame:
    """(doc_id, label, terms, counts, inside, ends): documents as packed numbers, written once; the only step that reads texts.

    ``terms`` are the slots of a document and ``counts`` how often each occurs, ``inside`` has the different terms of each
    sentence one after the other, as places in ``terms``, ``ends`` where each sentence ends in it. ``label`` is the language
    as labelled.
    """
    key = F.substring_index(F.substring_index(F.lower(F.trim(F.coalesce(F.col("lang").cast("string"), F.lit("")))), "-", 1), "_", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            flat: list[int] = []
            stops, docs = [], []
            for d, text in enumerate(batch.column("text").to_pylist()):
                for words in sentences(text):
                    flat.extend(slots(words))
                    stops.append(len(flat))
                    docs.append(d)
            n, slot, of_sentence = batch.num_rows, np.array(flat, np.int64), np.array(docs, np.int64)
            sentence = np.repeat(np.arange(len(stops)), np.diff(np.array([0, *stops])))
            pair, at, counts = np.unique(of_sentence[sentence] * SLOTS + slot, return_inverse=True, return_counts=True)
            doc = pair // SLOTS
            once = np.unique(sentence * max(1, len(pair)) + at)
            which, place = once // max(1, len(pair)), once % max(1, len(pair))
            inside = place - np.searchsorted(doc, np.arange(n))[of_sentence[which]]
            starts = np.searchsorted(of_sentence[which], np.arange(n))
            ends = np.searchsorted(which, np.arange(len(stops)), side="right") - starts[of_sentence]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), _by(doc, pair % SLOTS, n), _by(doc, counts, n), _by(of_sentence[which], inside, n), _by(of_sentence, ends, n)],
                names=["doc_id", "label", "terms", "counts", "inside", "ends"],
            )

    source = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), key.alias("label"))
    return materialize(source.mapInArrow(run, _ENCODED), "encoded")


def flat_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of all entries of a batch."""
    terms, sizes = unpacked(batch, "terms")
    return np.repeat(np.arange(batch.num_rows), sizes), terms, unpacked(batch, "counts")[0].astype(np.float32)


@dataclass
class Model:
    """Components on slots: ``subjects`` (subject, slot), ``backgrounds`` (language, slot).

    ``portions`` (subject, language) tell how much of a subject's component is in the terms of each language, as a document
    meets only those of its own.
    """

    subjects: np.ndarray
    backgrounds: np.ndarray
    portions: np.ndarray

    def likelihood(self, term: np.ndarray, language: np.ndarray) -> np.ndarray:
        """(part of the mixture, entry): of each entry's term; the last part is the background of the language."""
        return np.concatenate([self.subjects[:, term], self.backgrounds[language, term][None]])

    def scales(self, language: np.ndarray) -> np.ndarray:
        """(part of the mixture, document): what the likelihoods of a document are to be divided by."""
        return np.concatenate([self.portions[:, language], np.ones((1, len(language)), np.float32)])


def portions_of(words: np.ndarray) -> np.ndarray:
    """Shares of languages in each subject from words by subject and language, never quite 0."""
    total = words.sum(1, keepdims=True)
    return ((words + 1e-3 * total + 1) / (total * (1 + 1e-3 * words.shape[1]) + words.shape[1])).astype(np.float32)


#: Documents updated together, so that their terms stay in a core's cache.
CHUNK = 500


def split_counts(
    like: np.ndarray, row: np.ndarray, n: np.ndarray, size: int, mix: np.ndarray | None = None, steps: int = INNER, prior: float = PRIOR, scale: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multiplicative updates of the mixtures of ``size`` documents, the last split of the counts over their parts, and its
    sums by document.

    ``row`` tells the document of each entry and ascends; a document without entries keeps an even mixture. ``scale`` divides
    the likelihoods of a document.
    """
    lengths = np.bincount(row, minlength=size)
    held = np.flatnonzero(lengths)
    first = np.cumsum(lengths)[held] - lengths[held]
    mix = np.full((len(like), size), np.float32(1 / len(like))) if mix is None else mix
    spread, sums = like, np.zeros_like(mix)
    for _ in range(steps):
        spread = np.repeat(mix if scale is None else mix / scale, lengths, axis=1)
        spread *= like
        spread *= n / (spread.sum(0) + np.float32(1e-30))
        if len(held):
            sums[:, held] = np.add.reduceat(spread, first, axis=1)
        mix = sums + np.float32(prior)
        mix /= mix.sum(0)
    return mix, spread, sums


def mixtures(h: np.ndarray, row: np.ndarray, term: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, part) mixtures over the components ``h`` and (entry, part) split counts, from even mixtures on."""
    mix, part, _ = split_counts(h[:, term].astype(np.float32), row, n.astype(np.float32), size)
    return mix.T, part.T


def fitted(model: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mixtures, split counts, their sums by document, document and term of each entry) of a batch, from its last mixtures on."""
    row, term, n = flat_terms(batch)
    language = batch.column("language").to_numpy()
    scale = model.scales(language)
    before = unpacked(batch, "mix", np.float32)[0].reshape(batch.num_rows, -1).T
    mix, sums, part = np.empty_like(before), np.empty_like(before), np.empty((len(before), len(row)), np.float32)
    for start in range(0, batch.num_rows, CHUNK):
        end = min(batch.num_rows, start + CHUNK)
        low, high = np.searchsorted(row, [start, end])
        like = model.likelihood(term[low:high], language[row[low:high]])
        mix[:, start:end], part[:, low:high], sums[:, start:end] = split_counts(
            like, row[low:high] - start, n[low:high], end - start, before[:, start:end], scale=scale[:, start:end]
        )
    return mix, part, sums, row, term


# Passes over all documents. A pass writes the documents with their new mixtures and, for each task, sums: rows with a
# stretch of an array (row, slot) that holds what the task has met of it.
_ROWS = "doc_id bigint, language int, terms binary, counts binary, inside binary, ends binary, mix binary"
_SUMS = "part int, at int, slots binary, data binary"
STRETCH, FAN_IN = 1 << 12, 64


def _sum_rows(sums: np.ndarray, part: int) -> pa.RecordBatch:
    at, slots, data = [], [], []
    for start in range(0, sums.shape[1], STRETCH):
        met = np.flatnonzero(sums[:, start : start + STRETCH].any(0))
        if len(met):
            at.append(start // STRETCH)
            slots.append(met.astype(np.int16).tobytes())
            data.append(np.ascontiguousarray(sums[:, start + met], np.float32).tobytes())
    columns = [pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(slots, pa.binary()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "at", "slots", "data"])


def _take_up(sums: np.ndarray, at: int, slots: bytes, data: bytes) -> None:
    met = np.frombuffer(slots, np.int16).astype(np.int64) + at * STRETCH
    sums[:, met] += np.frombuffer(data, np.float32).reshape(len(sums), -1)


def _filled(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """``batch`` with all columns of ``schema``, null where it has none."""
    names = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in names else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def added_up(rows: DataFrame, parts: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all sums: added in a tree, FAN_IN tasks at a time and stretch by stretch."""
    stretches = -(-shape[1] // STRETCH)

    def add(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            at, part = table.column("at")[0].as_py(), table.column("part")[0].as_py() // FAN_IN
            sums = np.zeros((shape[0], STRETCH))
            for slots, data in zip(table.column("slots").to_pylist(), table.column("data").to_pylist()):
                _take_up(sums, 0, slots, data)
            out = _sum_rows(sums, part)
            yield out.set_column(1, "at", pa.array([at] * out.num_rows, pa.int32()))

    while parts > 1:
        groups = -(-parts // FAN_IN)
        block = F.floor(F.col("part") / FAN_IN) * stretches + F.col("at")
        rows, parts = map_blocks(rows.withColumn("block", block.cast("int")), "block", groups * stretches, add, _SUMS, max(1, stretches // 8)), groups
    total = np.zeros((shape[0], stretches * STRETCH), np.float32)
    for r in rows.select("at", "slots", "data").toLocalIterator():  # the model, whose size is fixed
        _take_up(total, *r)
    return total[:, : shape[1]]


class Pass:
    """What one pass does with each batch: ``step(batch, sums)`` adds to the sums and gives the rows to write, or None."""

    def __init__(self, rows: DataFrame, shape: tuple[int, int], step, label: str) -> None:
        fields = [("doc_id", pa.int64()), ("language", pa.int32()), *((c, pa.binary()) for c in ("terms", "counts", "inside", "ends", "mix"))]
        schema = pa.schema([*fields, ("part", pa.int32()), ("at", pa.int32()), ("slots", pa.binary()), ("data", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    out = step(batch, sums)
                    if out is not None:
                        yield _filled(out, schema)
            yield _filled(_sum_rows(sums, TaskContext.get().partitionId()), schema)

        self.written = materialize(rows.mapInArrow(run, f"{_ROWS}, {_SUMS}"), label)
        self.rows = self.written.where("doc_id is not null").select(*(f.split()[0] for f in _ROWS.split(", ")))
        self.sums = added_up(self.written.where("at is not null").select("part", "at", "slots", "data"), rows.rdd.getNumPartitions(), shape)


def by_label(rows: DataFrame, labels: list[str]) -> np.ndarray:
    """Words by language label and slot; labels outside of ``labels``, and none, are the last one."""
    places = {x: i for i, x in enumerate(labels)}

    def step(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        row, term, n = flat_terms(batch)
        label = np.array([places.get(x, BACKGROUNDS - 1) for x in batch.column("label").to_pylist()])[row]
        for g in np.unique(label):
            sums[g] += np.bincount(term[label == g], n[label == g], SLOTS)

    return Pass(rows, (BACKGROUNDS, SLOTS), step, "profiles").sums


def language_of(log_p: np.ndarray, row: np.ndarray, term: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The language whose term frequencies fit each document best, whatever its label says."""
    return np.stack([np.bincount(row, n * p[term], size) for p in log_p], 1).argmax(1)


def started(rows: DataFrame, profiles: np.ndarray, marks: dict[int, list[int]], k: int) -> tuple[Model, np.ndarray, DataFrame, DataFrame]:
    """The anchored start: the model, its anchors, and the documents with language and even mixtures (and their table).

    ``marks`` are the subjects of labelled documents. An anchor holds the terms that are more frequent in them than in the
    backgrounds of their languages.
    """
    met = profiles.sum(1) > 0
    log_p = np.where(met[:, None], np.log((profiles + 0.1) / (profiles.sum(1, keepdims=True) + 0.1 * SLOTS)), -1e9).astype(np.float32)
    sent = rows.sparkSession.sparkContext.broadcast((log_p, marks))

    def step(batch: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        log_p, marks = sent.value
        row, term, n = flat_terms(batch)
        size = batch.num_rows
        language = language_of(log_p, row, term, n, size)
        for g in np.unique(language):
            mine = language[row] == g
            sums[k + g, :SLOTS] += np.bincount(term[mine], n[mine], SLOTS)
        starts = np.searchsorted(row, np.arange(size + 1))
        for d, doc in enumerate(batch.column("doc_id").to_pylist()):
            for s in marks.get(doc, ()):
                mine = slice(starts[d], starts[d + 1])
                np.add.at(sums[s], term[mine], n[mine])
                sums[s, SLOTS + language[d]] += n[mine].sum()
        mix = _packed(np.arange(1, size + 1) * (k + 1), np.full(size * (k + 1), 1 / (k + 1), np.float32))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "terms", "counts", "inside", "ends")), pa.array(language.astype(np.int32)), mix],
            names=["doc_id", "terms", "counts", "inside", "ends", "language", "mix"],
        )

    first = Pass(rows, (k + BACKGROUNDS, SLOTS + BACKGROUNDS), step, "mixed")
    sent.unpersist()
    words, counts, by_language = first.sums[k:, :SLOTS], first.sums[:k, :SLOTS].astype(np.float64), first.sums[:k, SLOTS:].astype(np.float64)
    background = (words + np.float32(1e-9)) / (words + np.float32(1e-9)).sum(1, keepdims=True, dtype=np.float64).astype(np.float32)
    anchors = np.zeros((k, SLOTS), np.float32)
    for s in np.flatnonzero(counts.sum(1)):
        p = by_language[s] / by_language[s].sum() @ background + 1e-12
        q = (counts[s] + SMOOTH * p) / (counts[s].sum() + SMOOTH)
        lifted = q * np.maximum(0, np.log(q / p) - np.log(LIFT))
        anchors[s] = 0.95 * lifted / max(lifted.sum(), 1e-30) + 0.05 * p
    model = Model(anchors, background, portions_of(by_language))
    return model, anchors, first.rows, first.written


def update(rows: DataFrame, model: Model) -> Pass:
    """One round: mixtures taken on under the model, and the counts that they give to each component."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    k = len(model.subjects)

    def step(batch: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        mix, part, by_doc, row, term = fitted(sent.value, batch)
        language = batch.column("language").to_numpy()
        for s in range(k):
            sums[s, :SLOTS] += np.bincount(term, part[s], SLOTS)
            sums[s, SLOTS:] += np.bincount(language, by_doc[s], BACKGROUNDS)
        for g in np.unique(language):
            mine = language[row] == g
            sums[k + g, :SLOTS] += np.bincount(term[mine], part[k, mine], SLOTS)
        return batch.set_column(batch.schema.names.index("mix"), "mix", _packed(np.arange(1, batch.num_rows + 1) * (k + 1), mix.T.ravel()))

    out = Pass(rows, (k + BACKGROUNDS, SLOTS + BACKGROUNDS), step, "mixed")
    sent.unpersist()
    return out


def fit(documents: DataFrame, labels: DataFrame, subjects: list[str], label_rows: int = LABEL_ROWS) -> tuple[Model, DataFrame]:
    """The model, and the documents with the mixtures that it was fitted with."""
    rows = encoded(documents)
    commonest = rows.where("label <> ''").groupBy("label").count().orderBy(F.desc("count"), "label").limit(BACKGROUNDS - 1).collect()
    name = F.lower(F.regexp_replace("subject", r"(?U)^\s+|\s+\z", ""))
    places = {s.strip().lower(): i for i, s in enumerate(subjects)}
    sample = labels.where("doc_id is not null and subject is not null").select(F.col("doc_id").cast("bigint"), name.alias("label")).distinct()
    marks: dict[int, list[int]] = {}
    for doc, label in sample.where(F.col("label").isin(list(places))).orderBy(F.xxhash64("doc_id", "label")).limit(label_rows).collect():
        marks.setdefault(doc, []).append(places[label])
    model, anchors, mixed, table = started(rows, by_label(rows, [r[0] for r in commonest]), marks, len(subjects))
    for _ in range(ROUNDS):
        done = update(mixed, model)
        release(table)  # the documents are in the new table now
        mixed, table = done.rows, done.written
        k = len(subjects)
        sums, words = done.sums[:, :SLOTS] + np.float32(1e-12), done.sums[:k, SLOTS:]
        sums /= sums.sum(1, keepdims=True, dtype=np.float64).astype(np.float32)
        held = anchors.any(1, keepdims=True)
        own = np.where(held, (1 - ANCHOR) * sums[:k] + ANCHOR * anchors, 0)  # a subject without labels has no component
        model = Model(own.astype(np.float32), sums[k:], portions_of(words))
    return model, mixed


def shares(model: Model, subjects: list[str], rows: DataFrame) -> DataFrame:
    """(doc_id, subject, sentences, share, weight): of the sentences that deal with a subject, how many deal with each.

    The fitted mixture splits each term of a document over its parts; a sentence deals with the subject that gets most of
    its different terms. ``weight`` is the subject's part of the mixture.
    """
    sent = rows.sparkSession.sparkContext.broadcast((model, subjects))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, subjects = sent.value
        k = len(subjects)
        for batch in batches:
            if not batch.num_rows:
                continue
            mix, part, _, row, _ = fitted(model, batch)
            of_term = part[:k] / np.maximum(unpacked(batch, "counts")[0], 1)
            (ends, per_doc), (inside, sizes) = unpacked(batch, "ends"), unpacked(batch, "inside")
            doc = np.repeat(np.arange(batch.num_rows), per_doc)
            stops = ends + np.repeat(np.cumsum(sizes) - sizes, per_doc)
            which = np.repeat(np.arange(len(stops)), np.diff(np.concatenate([[0], stops])))
            entry = inside + np.searchsorted(row, np.arange(batch.num_rows))[doc[which]]
            gain = np.stack([np.bincount(which, of_term[s, entry], len(stops)) for s in range(k)], 1)
            best = gain.argmax(1)
            good = gain[np.arange(len(best)), best] >= EVIDENCE
            table = np.bincount(doc[good] * k + best[good], minlength=batch.num_rows * k).reshape(-1, k)
            d, s = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(d)),
                    pa.array([subjects[i] for i in s], pa.string()),
                    pa.array(table[d, s].astype(np.int32)),
                    pa.array(table[d, s] / np.maximum(1, table.sum(1))[d]),
                    pa.array(mix[s, d].astype(np.float64)),
                ],
                names=["doc_id", "subject", "sentences", "share", "weight"],
            )

    return rows.mapInArrow(run, "doc_id bigint, subject string, sentences int, share double, weight double")


def subject_shares(documents: DataFrame, areas: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """(doc_id, subject, sentences, share, weight) for every document with a sentence on a subject of ``areas``.

    Labels are compared without letter case and white space around; labels of other subjects (``none`` too) and nulls anchor
    nothing. A subject without any label is never found. Null and empty texts, and texts without a word, have no rows;
    repeated rows give repeated rows. Without documents, areas or labels the result is empty.
    """
    names = sorted({r[0] for r in areas.where("subject is not null").select("subject").distinct().collect()})  # a fixed table
    if not names or not documents.take(1):
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string, sentences int, share double, weight double")
    model, rows = fit(documents, labels, names, label_rows)
    return shares(model, names, rows)
