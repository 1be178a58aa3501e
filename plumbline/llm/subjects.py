"""Subject areas of documents by a distributed latent Dirichlet topic model.

1. Texts become sentences and terms (words, adjacent word pairs, pairs of Han characters). Headings and line prefixes are
   no sentences. Terms are counted over all documents; those with at least a given share of their language's occurrences
   form the vocabulary, whatever the size of the corpus.
2. The topic model draws a document's topic proportions from a Dirichlet prior, a topic for each of its sentences from
   these proportions, and each term of the sentence from that topic or from its language's background. It is fitted by
   variational expectation maximisation: each round is one job over all documents, in which every task infers the topics
   of its documents' sentences and adds up expected term counts per topic; the sums of the bounded vocabulary are the
   next topics. One topic per area and language starts from the hand-labelled documents, one background topic per
   language from its own term counts, and a labelled document's prior leans to its areas. The languages are those of the
   data.
3. Each topic's top terms are inspected: the areas whose labelled documents hold these terms most give the topic its
   area, or none where no area stands out.
4. With the last topics the proportions of every document are inferred, as its sentences' shares of the topics. A
   document is assigned the areas whose topics together have at least the given proportion.

Defined results: null, empty and blank texts, and texts without sentences, have no area. Copies get the same areas.
Without labelled documents no topic can be mapped and no area is assigned.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize, spread

#: A term of the vocabulary has at least this share of the occurrences of a language, so that a language has at most
#: 1 / LEAST_SHARE of them (that bounds what is broadcast), and LEAST_COUNT occurrences.
LEAST_SHARE, LEAST_COUNT = 2e-6, 3
#: Rounds over all documents, and rounds of inference within a document.
ROUNDS, INNER_ROUNDS = 3, 4
#: Dirichlet priors in sentences: of an area's topic, of a background topic, of a labelled document's areas; SMOOTH: the
#: part of a topic that is spread as all terms together are.
PRIOR, BACKGROUND_PRIOR, LABEL_PRIOR, SMOOTH = 0.1, 0.5, 1.0, 0.02
#: The chance that a term in a sentence of an area's topic is the topic's own and not one of the background.
OWN = 0.3
#: A sentence has no subject unless its terms are exp(ODDS) times likelier by an area's topic than by the background.
ODDS = 3.0
#: A language has topics of its own if at least this share of the documents is in it.
LEAST_LANGUAGE = 0.003
#: How many top terms of a topic are inspected; how far beyond chance (0) towards certainty (1) its area must stand out.
TOP_TERMS, LEAST_LEAD = 60, 0.22
SHARE = 0.25

_HEADING = re.compile(r"^\W*[^\W\d_㐀-鿿]+\W+\d+\W*$")
_PREFIX = re.compile(r"^\s*(?:\[\s*\d[\d:.,\s]*\]\s*[^\W\d_]{3,9}\b|[-*•–]\s+|\d+[.)]\s+)\s*")
_CODE = re.compile(r"[A-Za-z0-9._#/%\-\[\]]*[0-9_][A-Za-z0-9._#/%\-\[\]]*")
_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+")
_INVISIBLE = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Cf") + "]")
_HAN = re.compile(r"[㐀-鿿]+")


def _unwrapped(text: str) -> str:
    """The prose of a text that is a JSON object: its string values of several words."""
    try:
        values = json.loads(text).values()
    except (ValueError, AttributeError):
        return text
    return "\n".join(v for v in values if isinstance(v, str) and len(v.split()) > 1) or text


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: lower case, compatibility forms resolved, invisible characters, prefixes and codes gone."""
    if not text:
        return []
    if text.lstrip().startswith("{"):
        text = _unwrapped(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    found = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") and _HEADING.match(line) or _HEADING.match(line):
            continue
        line = _PREFIX.sub("", line, count=1)
        for sentence in _END.split(line):
            sentence = _CODE.sub(" ", sentence)
            words = _WORD.findall(sentence)
            # a lone word or sign after a sentence is none itself
            if len(words) > 1 or words and len(words[0]) > 2 and _HAN.search(words[0]):
                found.append(sentence)
    return found


def terms(sentence: str) -> list[str]:
    """Words, pairs of adjacent words and pairs of adjacent Han characters."""
    out: list[str] = []
    words: list[str] = []
    for word in _WORD.findall(sentence):
        if _HAN.search(word):
            for run in _HAN.findall(word):
                out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        else:
            words.append(word)
    out += words
    out += [f"{a} {b}" for a, b in zip(words, words[1:])]
    return out


def _split(df: DataFrame) -> DataFrame:
    """id, lang, sentence numbers and terms of every document with sentences; the tokens are written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sizes, found = [], []
                for text in batch.column(2).to_pylist():
                    own = [terms(s) for s in sentences(text)]
                    sizes.append([len(t) for t in own])
                    found.append([t for ts in own for t in ts])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], names=["id", "lang", "sizes", "terms"])

    return spread(df.select("id", "lang", "text"), "id").mapInArrow(run, "id bigint, lang string, sizes array<int>, terms array<string>")


def vocabulary(split: DataFrame, share: float = LEAST_SHARE, least: int = LEAST_COUNT) -> list[str]:
    """The terms with at least so large a share of a language's occurrences; counted over all documents, by Arrow
    within the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[pa.Array]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                counts = pc.value_counts(pa.chunked_array(parts, pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), counts.field(0), counts.field(1)], names=["lang", "term", "n"])

        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                same = pc.is_null(batch.column(0)) if lang is None else pc.equal(batch.column(0), lang)
                held.setdefault(lang, []).append(batch.column(1).filter(same).flatten())
                size += len(held[lang][-1])
            if size > 4_000_000:
                yield from out()
                held, size = {}, 0
        yield from out()

    counts = split.select("lang", "terms").mapInArrow(run, "lang string, term string, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "term-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))  # one row per language
    often = counts.join(F.broadcast(totals), counts.lang.eqNullSafe(totals.lang)).filter((F.col("n") >= least) & (F.col("n") >= share * F.col("all")))
    return sorted(r.term for r in often.select("term").distinct().collect())


def _encode(split: DataFrame, terms_: list[str]) -> DataFrame:
    """id, lang, sizes, codes: the terms' numbers in the vocabulary, -1 for others."""
    sent = split.sparkSession.sparkContext.broadcast(terms_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            column = batch.column(3)
            codes = pc.fill_null(pc.index_in(column.flatten(), value_set=known), -1)
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), codes)], names=["id", "lang", "sizes", "codes"])

    return split.mapInArrow(run, "id bigint, lang string, sizes array<int>, codes array<int>")


def _known(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document of every sentence of the batch, and (sentence, code) of every known term."""
    sizes, codes = batch.column("sizes"), batch.column("codes").flatten().to_numpy(zero_copy_only=False)
    document = np.repeat(np.arange(batch.num_rows), np.diff(sizes.offsets.to_numpy()))
    sentence = np.repeat(np.arange(len(document)), sizes.flatten().to_numpy(zero_copy_only=False))
    known = codes >= 0
    return document, sentence[known], codes[known]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


class Layout:
    """Which topic is where: those of an area by language, then the backgrounds of the languages.

    Documents of no language start no topic, but are inferred with all; where no document has one, all are of one.
    """

    def __init__(self, areas: list[str], languages: list[str]):
        self.areas, self.languages = areas, languages or [None]
        self.first = len(areas) * len(self.languages)
        self.width = self.first + len(self.languages)

    def topic(self, area: int, lang: str | None) -> int:
        return area * len(self.languages) + self.languages.index(lang)

    def of_area(self, area: int) -> slice:
        return slice(area * len(self.languages), (area + 1) * len(self.languages))

    def background(self, lang: str | None) -> int:
        return self.first + self.languages.index(lang)


def _count(encoded: DataFrame, size: int, layout: Layout) -> np.ndarray:
    """Term counts of the areas' labelled documents by language, then of the languages: size x topics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, layout.width))
        for batch in _pieces(batches, 1024):
            weight = np.zeros((batch.num_rows, layout.width))
            for i, (lang, own) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("areas").to_pylist())):
                if lang not in layout.languages:
                    continue
                for a in own or ():
                    weight[i, layout.topic(a, lang)] = 1 / len(own)
                weight[i, layout.background(lang)] = 1
            document, sentence, code = _known(batch)
            owner = document[sentence]
            for k in np.flatnonzero(weight.any(0)):
                w = weight[owner, k]
                used = np.flatnonzero(w)
                total[:, k] += np.bincount(code[used], w[used], size)
        yield from _partial(total)

    return _gather(encoded, run, size, layout.width)


def _partial(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(total[used, k]) for k in range(total.shape[1])]], names=["code", *[f"k{k}" for k in range(total.shape[1])]])


def _gather(encoded: DataFrame, run, size: int, width: int) -> np.ndarray:
    """The tasks' sums added up by term: as many rows as the vocabulary has terms reach the driver.

    Every task gives one row per term, so many small tasks are put together, without a shuffle, to a few for each core.
    """
    names = [f"k{k}" for k in range(width)]
    few = 4 * encoded.sparkSession.sparkContext.defaultParallelism
    tasks = encoded.coalesce(few) if encoded.rdd.getNumPartitions() > few else encoded
    sums = tasks.mapInArrow(run, "code int, " + ", ".join(f"{n} double" for n in names)).groupBy("code").agg(*[F.sum(n).alias(n) for n in names])
    total = np.zeros((size, width))
    frame = sums.toArrow()
    total[frame.column("code").to_numpy()] = np.column_stack([frame.column(n).to_numpy() for n in names]) if frame.num_rows else np.empty((0, width))
    return total


def _distributions(counts: np.ndarray, overall: np.ndarray) -> np.ndarray:
    """Smoothed term distributions, one per column; a topic without counts stays empty."""
    rest = (overall + 1e-9) / (overall + 1e-9).sum()
    sizes = counts.sum(0)
    return (counts + SMOOTH * sizes * rest[:, None]) / np.maximum((1 + SMOOTH) * sizes, 1e-12)


def _mixed(topics: np.ndarray, layout: Layout) -> np.ndarray:
    """The probability of a term in a sentence of a topic: by chance OWN the topic's, else its language's background's."""
    mixed = np.maximum(topics, 1e-12)
    for lang in layout.languages:
        own = [layout.topic(a, lang) for a in range(len(layout.areas))]
        mixed[:, own] = OWN * topics[:, own] + (1 - OWN) * topics[:, [layout.background(lang)]]
    return mixed


def _start(counts: np.ndarray, layout: Layout) -> np.ndarray:
    """The first topics' term counts, out of those of the labelled documents and of the languages.

    An area's topic starts from what sets the area apart from the others of its language: what exceeds the mean rate of
    the term by the square root of the number of areas, half way, in logarithms, from a term that all areas use alike to
    one that a single area uses. The language's background starts from its own counts without the terms set apart.
    """
    start = counts.copy()
    for lang in layout.languages:
        own = [k for k in (layout.topic(a, lang) for a in range(len(layout.areas))) if counts[:, k].any()]
        if len(own) > 1:
            held, few = counts[:, own], 1 / np.sqrt(len(own))
            rate = held / held.sum(0)
            apart = np.maximum(0.0, 1 - rate.mean(1, keepdims=True) / few / np.maximum(rate, 1e-12))
            start[:, own] = held * apart
            # 1 for a term of a single area, 0 for one that no area uses more than others; of few mentions less is known
            mentions = held.sum(1)
            told = start[:, own].sum(1) / np.maximum(mentions, 1e-12) / (1 - few) * np.maximum(0.0, 1 - 1 / np.sqrt(np.maximum(mentions, 1.0)))
            start[:, layout.background(lang)] *= np.maximum(0.0, 1 - told)
    return start


def _next(expected: np.ndarray, topics: np.ndarray, layout: Layout, overall: np.ndarray) -> np.ndarray:
    """The topics by the expected term counts of their sentences: what the background explains there is the background's."""
    counts, mixed = expected.copy(), _mixed(topics, layout)
    for lang in layout.languages:
        own = [layout.topic(a, lang) for a in range(len(layout.areas))]
        counts[:, own] *= OWN * topics[:, own] / mixed[:, own]
        counts[:, layout.background(lang)] += (expected[:, own] - counts[:, own]).sum(1)
    return _distributions(counts, overall)


def _by_language(topics: np.ndarray, layout: Layout, owner: np.ndarray, code: np.ndarray, documents: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(topics, terms): a document of one language needs that language's topics and the backgrounds, another one all."""
    langs, first = len(layout.languages), layout.first
    backgrounds = np.arange(first, layout.width)
    weight = topics[code, first : first + langs]
    weight = weight / np.maximum(weight.sum(1, keepdims=True), 1e-30)
    held = np.zeros((documents, langs))
    for k in range(langs):
        held[:, k] = np.bincount(owner, weight[:, k], documents)
    main = np.where(held.max(1) >= 0.9 * held.sum(1), held.argmax(1), -1) if langs else np.full(documents, -1)
    for k in range(-1, langs):
        own = np.flatnonzero(main[owner] == k)
        if len(own):
            yield np.concatenate([np.arange(first) if k < 0 else np.arange(k, first, langs), backgrounds]), own


def _infer(logs: np.ndarray, odds: np.ndarray, prior: np.ndarray, document: np.ndarray, sentence: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, its shares of the topics) for the sentences with known terms; terms in the order of sentences.

    odds: against each topic, as logarithms. prior: documents x topics. document: of every sentence.
    """
    edges = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    told = sentence[edges]
    likely = np.add.reduceat(logs[code], edges, axis=0) - odds
    likely = np.exp(likely - likely.max(1, keepdims=True))
    owner = document[told]
    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    proportions = prior + np.float32(0.1)
    for _ in range(INNER_ROUNDS):
        share = likely * proportions[owner]
        share /= share.sum(1, keepdims=True)
        proportions = prior.copy()
        proportions[owner[firsts]] += np.add.reduceat(share, firsts, axis=0)
    return told, share


def _inferred(topics: np.ndarray, logs: np.ndarray, layout: Layout, batch: pa.RecordBatch, labels: bool, odds: float) -> Iterator[tuple]:
    """(topic columns, document of every sentence, sentences, their shares, number in sentences and code of every term),
    by language. logs: of the mixed topics."""
    document, sentence, code = _known(batch)
    if not len(code):
        return
    prior = np.full((batch.num_rows, layout.width), PRIOR, np.float32)
    prior[:, layout.first :] = BACKGROUND_PRIOR
    for i, own in enumerate(batch.column("areas").to_pylist() if labels else ()):
        for a in own or ():
            prior[i, layout.of_area(a)] = LABEL_PRIOR
    for columns, own in _by_language(topics, layout, document[sentence], code, batch.num_rows):
        told, share = _infer(logs[:, columns], np.where(columns < layout.first, np.float32(odds), np.float32(0)), prior[:, columns], document, sentence[own], code[own])
        yield columns, document, told, share, np.searchsorted(told, sentence[own]), code[own]


def _round(encoded: DataFrame, topics: np.ndarray, layout: Layout) -> np.ndarray:
    """One round of expectation over all documents: expected term counts per topic."""
    sent = encoded.sparkSession.sparkContext.broadcast(topics.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = sent.value
        logs, total = np.log(_mixed(topics, layout)), np.zeros(topics.shape)
        for batch in _pieces(batches, 512):
            for columns, _, _, share, place, code in _inferred(topics, logs, layout, batch, True, ODDS):
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
                total[np.ix_(code[order][at], columns)] += np.add.reduceat(share[place[order]], at, axis=0)
        yield from _partial(total)

    found = _gather(encoded, run, *topics.shape)
    sent.unpersist()
    return found


class SubjectModel:
    """Terms, topics (terms x topics), where these are, and the area of each topic."""

    def __init__(self, terms_: list[str], topics: np.ndarray, layout: Layout, area_of: list[str | None]):
        self.terms, self.topics, self.layout, self.area_of = terms_, topics, layout, area_of
        self.areas = layout.areas

    def top_terms(self, topic: int, n: int = TOP_TERMS) -> list[str]:
        """The terms that a topic holds most of beyond the background topics (of a background, beyond all topics)."""
        first = self.layout.first
        usual = self.topics[:, first:].max(1) if topic < first else self.topics.mean(1)
        weight = self.topics[:, topic] * np.log(np.maximum(self.topics[:, topic], 1e-30) / np.maximum(usual, 1e-30))
        return [self.terms[i] for i in np.argsort(-weight, kind="stable")[:n]]


def map_topics(terms_: list[str], topics: np.ndarray, labelled: np.ndarray, layout: Layout) -> list[str | None]:
    """The area of each topic by its top terms: the area whose labelled documents hold them most, beyond its size.

    labelled: the term counts of the labelled documents, terms x (areas by languages).
    """
    areas = layout.areas
    rate = labelled / np.maximum(labelled.sum(0), 1.0)
    rate = rate.reshape(len(terms_), len(areas), len(layout.languages)).sum(2)
    share = rate / np.maximum(rate.sum(1, keepdims=True), 1e-12)
    probe = SubjectModel(terms_, topics, layout, [None] * topics.shape[1])
    number = {t: i for i, t in enumerate(terms_)}
    chance = 1 / max(1, len(areas))
    found: list[str | None] = []
    for k in range(topics.shape[1]):
        top = [number[t] for t in probe.top_terms(k)]
        weight = topics[top, k] / max(topics[top, k].sum(), 1e-12)
        held = weight @ share[top]
        found.append(areas[int(held.argmax())] if held.size and (held.max() - chance) / max(1e-9, 1 - chance) >= LEAST_LEAD else None)
    return found


def languages_of(documents: DataFrame, share: float = LEAST_LANGUAGE) -> list[str]:
    """The languages of at least so large a share of the documents; at most 1 / share of them."""
    counts = documents.groupBy("lang").agg(F.count("*").alias("n"))
    return sorted(r.lang for r in counts.filter((F.col("n") >= share * documents.count()) & F.col("lang").isNotNull()).collect())


def fit_subjects(documents: DataFrame, areas: list[str], examples: DataFrame, rounds: int = ROUNDS) -> tuple[SubjectModel, DataFrame]:
    """The model, and the encoded documents it was fitted on. documents: id, lang, text; examples: id, area."""
    split = materialize(_split(documents), "terms")
    words = vocabulary(split)
    layout = Layout(areas, languages_of(split))
    number = F.create_map(*[x for i, a in enumerate(areas) for x in (F.lit(a), F.lit(i))]).cast("map<string,int>")
    labels = examples.filter(F.col("area").isin(areas)).groupBy("id").agg(F.sort_array(F.collect_set(F.try_element_at(number, F.col("area")))).alias("areas"))
    encoded = materialize(_encode(split, words).join(labels, "id", "left"), "encoded")
    topics = np.zeros((len(words), layout.width))
    area_of: list[str | None] = [None] * layout.width
    if words:
        counts = _count(encoded, len(words), layout)
        overall = counts[:, layout.first :].sum(1)
        topics = _distributions(_start(counts, layout), overall)
        for _ in range(rounds):
            topics = _next(_round(encoded, topics, layout), topics, layout, overall)
        area_of = map_topics(words, topics, counts[:, : layout.first], layout)
    return SubjectModel(words, topics, layout, area_of), encoded


def topic_proportions(encoded: DataFrame, model: SubjectModel, names: list[str | None] | None = None, odds: float = ODDS) -> DataFrame:
    """id, name, proportion: the part of a document's sentences whose most probable topic has the name.

    names: of the topics, their numbers if not given. Topics of one name are added up, those without one are left out.
    """
    named = [str(k) for k in range(model.layout.width)] if names is None else names
    distinct = sorted({n for n in named if n is not None})
    number = np.array([distinct.index(n) if n is not None else -1 for n in named])
    sent = encoded.sparkSession.sparkContext.broadcast(model.topics.astype(np.float32))
    layout = model.layout

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = sent.value
        logs = np.log(_mixed(topics, layout))
        for batch in _pieces(batches, 512):
            for columns, document, told, share, _, _ in _inferred(topics, logs, layout, batch, False, odds):
                whole = np.bincount(document, minlength=batch.num_rows)
                own = number[columns[share.argmax(1)]]
                told, own = told[own >= 0], own[own >= 0]
                pair, count = np.unique(document[told] * len(distinct) + own, return_counts=True)
                owner = pair // max(1, len(distinct))
                name = pa.array([distinct[i] for i in pair % max(1, len(distinct))], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), name, pa.array(count / whole[owner])], names=["id", "name", "proportion"])

    return encoded.mapInArrow(run, "id bigint, name string, proportion double")


def assign_subjects(encoded: DataFrame, model: SubjectModel, share: float = SHARE) -> DataFrame:
    """id, area, share: the areas whose topics together have at least the given proportion of a document."""
    found = topic_proportions(encoded, model, model.area_of).filter(F.col("proportion") >= share)
    return found.select("id", F.col("name").alias("area"), F.col("proportion").alias("share"))
