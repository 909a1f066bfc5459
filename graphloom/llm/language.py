"""Languages of documents and of their stretches in one language (problem 8).

Word-first backoff: a word of a sentence that the model knows is scored by its
frequency in each language; any other falls back to its character n-grams, from
long ones to shorter ones, until enough of them are known.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.tables import written

#: The model is fitted on about so many labelled documents, as even over the languages as they allow, chosen by hash of the id. Documents longer than LONGEST_TRAINING characters are not fitted on; all are classified.
TRAINING_DOCUMENTS = 8_000
LONGEST_TRAINING = 20_000
#: Bounds of the model, and with it of what is broadcast.
MOST_WORDS = 30_000
MOST_GRAMS = 120_000
LONGEST_GRAM = 5
ROUNDS = 4
SMALLEST = 0.2
#: Part of a word's n-grams that must be known for them to count, and of those of a run of Han characters.
KNOWN, HAN_KNOWN = 0.5, 0.8
#: Sentences judged together.
AT_ONCE = 20_000
#: Words that a worker keeps the backed-off score of.
KEPT_WORDS = 100_000
#: A sentence whose best language leads by less (natural logarithm of the odds) takes the language of its neighbours.
LEAST_LEAD = 2.0

_WORD = regex.compile(r"\p{Han}+|(?<![\p{L}\p{M}\p{N}_])\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*(?![\p{L}\p{N}_])")
_HAN = regex.compile(r"\p{Han}")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
# the same as the two above for texts of ASCII only, in the faster engine
_ASCII_WORD = re.compile(r"(?<![a-z0-9_])[a-z]+(?:'[a-z]+)*(?![a-z0-9_])")
_ASCII_LETTERS = re.compile(r"[A-Za-z]+")
_LINE = re.compile("\r\n|[\r\n\u2028\u2029\x85\x0b\x0c]")
_BREAK = re.compile(r"""[.?!…][)"'”’»\]]*(?=\s)|[。？！]""")
_CODE = re.compile(r"[{}\[\]=<>|#;_+*\\/^&~@$]")
_MISREAD = regex.compile(r"[Â-ôŒœŠšŸŽžƒ][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™][\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘-‚“-„†-•…‰‹›€™]*")


_INVISIBLE = regex.compile(r"[\p{Cf}]")


def _reread(m: regex.Match) -> str:
    for encoding in ("latin-1", "cp1252"):
        try:
            return m[0].encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def repaired(text: str) -> str:
    """``text`` with UTF-8 that was read as a single-byte encoding put right where that gives valid UTF-8, letters in their composed form, and without invisible characters."""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", _MISREAD.sub(_reread, text)))


def is_prose(line: str) -> bool:
    """Whether a line may hold sentences, and is no code, table, numbers or graph line."""
    filled = len("".join(line.split()))
    if not filled or len(_CODE.findall(line)) > 0.12 * filled:
        return False
    return len("".join((_ASCII_LETTERS if line.isascii() else _LETTERS).findall(line))) >= 0.5 * filled


def _cut(paragraph: str) -> Iterator[str]:
    """The sentences of a paragraph: a full stop and its closing marks end one before white space, a wide one anywhere."""
    at = 0
    for m in _BREAK.finditer(paragraph):
        yield paragraph[at : m.end()]
        at = m.end()
    yield paragraph[at:]


def sentences(text: str) -> list[str]:
    """The candidates for sentences, in reading order; blank lines and lines that are no prose end one, other line breaks don't."""
    out: list[str] = []
    held: list[str] = []
    for line in [*_LINE.split(repaired(text)), ""]:
        if is_prose(line):
            held.append(line)
        elif held and (not line.strip() or not _continues(line)):
            out += [s for s in _cut(" ".join(held)) if s and not s.isspace()]
            held = []
        elif held:
            held.append(line)
    return out


def _continues(line: str) -> bool:
    """Whether a line that is no prose by its letters is the rest of a wrapped sentence: few characters, some of them words."""
    return len(line) < 80 and not line[:1].isspace() and len(_CODE.findall(line)) <= 0.12 * len(line) and bool(_WORD.search(line)) and line.rstrip()[-1:] in ".?!。？！,;"


def words(sentence: str) -> list[str]:
    if sentence.isascii():
        return _ASCII_WORD.findall(sentence.lower())
    return [w.replace("’", "'") for w in _WORD.findall(sentence.lower())]


def _weight(word: str) -> int:
    """For how many words a word counts: a run of Han characters for one in two characters."""
    return max(1, len(word) // 2) if _HAN.match(word) else 1


def grams(word: str, n: int) -> list[str]:
    """Character n-grams; a word of an alphabet has its ends marked, a run of Han characters is no word and has not."""
    if not _HAN.match(word):
        word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _leads(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best column of each row, and by how much it leads the second best."""
    best = total.argmax(1)
    if total.shape[1] == 1:
        return best, np.full(len(total), 50.0)
    rest = total.copy()
    rest[np.arange(len(total)), best] = -np.inf
    return best, total[np.arange(len(total)), best] - rest.max(1)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts``; no run is empty."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, *values.shape[1:]))


def judged(flat: np.ndarray, starts: np.ndarray, scores: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sentences, given as runs of words: language, lead over the second best, weight, and whether it is one.

    ``flat`` has the words as rows of ``scores`` and ``facts``: a word's weight, how
    much of that is known, how much only looks like a word, and whether it has more
    than one letter. It is no sentence if it has not two different known words of
    more than a letter, or these are under a third, words that only look like some
    counted half.
    """
    best, lead = _leads(_sums(scores[flat], starts))
    weight, known, like, _ = _sums(facts[flat], starts).T
    ok = (known >= 2) & (6 * known + 3 * like >= 2 * weight)
    # two different known words, or one that counts for two
    counted = ((facts[:, 3] > 0) & (facts[:, 1] > 0))[flat]
    if len(starts):
        high = np.maximum.reduceat(np.where(counted, flat, -1), starts)
        low = np.minimum.reduceat(np.where(counted, flat, len(facts)), starts)
        ok &= (high > low) | ((high == low) & (facts[high, 1] >= 2))
    return best, lead, weight, ok


@dataclass
class Model:
    """Natural logarithms of relative frequencies, a column for each language."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    kept: dict[str, int] = field(default_factory=dict)
    kept_scores: np.ndarray | None = None
    kept_facts: np.ndarray | None = None

    def backed_off(self, word: str) -> tuple[np.ndarray, int]:
        """Scores of a word by the longest n-grams of which most are known, and their length; 0 if none are.

        Most: half, or of the n-grams of a run of Han characters, which is several words, four in five.
        """
        least = HAN_KNOWN if _HAN.match(word) else KNOWN
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            all_grams = grams(word, n)
            known = [self.grams[g] for g in all_grams if g in self.grams]
            if known and len(known) >= least * len(all_grams):
                return self.gram_scores[known].sum(0) / n, n
        return np.zeros(len(self.languages)), 0

    def _keep(self, word: str) -> int:
        """Where the word's scores and facts are."""
        at = len(self.kept)
        if self.kept_scores is None:
            self.kept_scores, self.kept_facts = np.zeros((1024, len(self.languages))), np.zeros((1024, 4))
        elif at >= len(self.kept_scores):
            self.kept_scores, self.kept_facts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.kept_scores, self.kept_facts))
        row = self.words.get(word)
        if row is not None:
            self.kept_scores[at], n = self.word_scores[row], 0
        else:
            self.kept_scores[at], n = self.backed_off(word)
        self.kept_facts[at] = _facts(word, row is not None, n)
        self.kept[word] = at
        return at

    def judge(self, found: list[list[str]]) -> list[tuple[int, float, float] | None]:
        """Language, lead and weight of each sentence, given as its words; None if it is none. See ``judged``."""
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        kept, keep = self.kept, self._keep
        flat = [kept[w] if w in kept else keep(w) for s in found for w in s]
        some = [i for i, s in enumerate(found) if s]
        out: list[tuple[int, float, float] | None] = [None] * len(found)
        if flat:
            lengths = np.array([len(found[i]) for i in some])
            columns = judged(np.array(flat), np.cumsum(lengths) - lengths, self.kept_scores, self.kept_facts)
            for i, best, lead, weight, ok in zip(some, *(c.tolist() for c in columns), strict=True):
                if ok:
                    out[i] = (best, lead, weight)
        return out

    def sentence(self, text: str) -> tuple[int, float, float] | None:
        return self.judge([words(text)])[0]


def _facts(word: str, listed: bool, n: int) -> tuple[float, float, float, float]:
    """Weight, what of it is known and what looks like a word, and whether it has more than one letter; ``n`` is the length of the n-grams it was scored by if it is not ``listed``."""
    weight, han = _weight(word), bool(_HAN.match(word))
    known = weight if listed or (han and n) else 0
    return weight, known, weight if not listed and n > 2 and not han else 0, han or len(word) > 1


def _scores(table: np.ndarray, keys: list[str], most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``keys`` are the ``most`` frequent that occur ``least`` times, and the logarithms of their relative frequencies; ``table`` has their numbers by language.

    What a language lacks has the same small frequency in all, and a language with
    little text counts as if it had SMALLEST of the largest one's: else its few
    texts, and the wrong labels among them, would outweigh the others'.
    """
    total = table.sum(1)
    chosen = np.array(sorted(np.flatnonzero(total >= least).tolist(), key=lambda i: (-total[i], keys[i]))[:most], dtype=np.int64)
    sums = table.sum(0)
    largest = max(1.0, sums.max(initial=1.0))
    return chosen, np.log(table[chosen] / np.maximum(sums, SMALLEST * largest) + 0.05 / largest)


class _Vocabulary:
    """The distinct words of the training texts and their n-grams, by number."""

    def __init__(self, all_words: Iterable[str]) -> None:
        self.words = sorted(all_words)
        self.han = np.array([bool(_HAN.match(w)) for w in self.words], dtype=bool)
        #: By length the distinct n-grams, the n-grams of all words one after the other, and where those of a word start.
        self.grams: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        for n in range(1, LONGEST_GRAM + 1):
            number: dict[str, int] = {}
            flat, starts = [], []
            for w in self.words:
                starts.append(len(flat))
                flat += [number.setdefault(g, len(number)) for g in grams(w, n)]
            self.grams.append((list(number), np.array(flat, dtype=np.int64), np.array([*starts, len(flat)], dtype=np.int64)))

    def model(self, counts: np.ndarray, languages: list[str]) -> tuple[Model, np.ndarray, np.ndarray, np.ndarray]:
        """The model of the words' ``counts`` by language, with the scores and facts of all words and their scores by n-grams."""
        # a run of Han characters is no word: it is known by its n-grams only
        chosen, word_scores = _scores(np.where(self.han[:, None], 0.0, counts), self.words, MOST_WORDS, 3)
        index, parts, offset = {}, [], 0
        letters, length = np.zeros_like(counts), np.zeros(len(self.words), dtype=np.int64)
        for n, (keys, flat, starts) in enumerate(self.grams, 1):
            of_word = np.repeat(np.arange(len(self.words)), np.diff(starts))
            table = np.stack([np.bincount(flat, weights=counts[of_word, i], minlength=len(keys)) for i in range(counts.shape[1])], 1) if len(flat) else np.zeros((len(keys), counts.shape[1]))
            own, part = _scores(table, keys, MOST_GRAMS // LONGEST_GRAM, 3)
            index.update((keys[g], offset + i) for i, g in enumerate(own.tolist()))
            offset += len(own)
            parts.append(part)
            # words of which most n-grams are known: the longest come last and stay
            row = np.full(len(keys), -1)
            row[own] = np.arange(len(own))
            place = row[flat]
            inside, all_of = np.bincount(of_word[place >= 0], minlength=len(self.words)), np.diff(starts)
            most = (inside > 0) & (inside >= np.where(self.han, HAN_KNOWN, KNOWN) * all_of)
            use = (place >= 0) & most[of_word]
            sums = np.stack([np.bincount(of_word[use], weights=part[place[use], i], minlength=len(self.words)) for i in range(counts.shape[1])], 1)
            letters[most] = sums[most] / n
            length[most] = n
        scores, listed = letters.copy(), np.zeros(len(self.words), dtype=bool)
        scores[chosen], listed[chosen] = word_scores, True
        facts = np.array([_facts(w, is_listed, n) for w, is_listed, n in zip(self.words, listed.tolist(), length.tolist(), strict=True)], dtype=float).reshape(-1, 4)
        words_at = {self.words[i]: at for at, i in enumerate(chosen.tolist())}
        return Model(languages, words_at, word_scores, index, np.concatenate(parts)), scores, facts, letters


def fit(labelled: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """A model from texts with labels of which some are wrong.

    At first each sentence is taken to be in the language of its document's label.
    As a long text with a wrong label would speak for many rare words, the first
    judgement goes by letters too: by the n-grams of words, counted once per text.
    Then each sentence counts for the language that the model before finds for
    it, so wrong labels and texts in several languages lose their influence.
    """
    languages = sorted({lang for _, lang in labelled})
    every: Counter = Counter()
    by_label = [Counter() for _ in languages]
    for text, lang in labelled:
        found = [tuple(f) for f in map(words, sentences(text)) if f]
        every.update(found)
        by_label[languages.index(lang)].update({w for f in found for w in f})
    if not every:
        return Model(languages, {}, np.zeros((0, len(languages))), {}, np.zeros((0, len(languages))))
    vocabulary = _Vocabulary({w for f in every for w in f})
    number = {w: i for i, w in enumerate(vocabulary.words)}
    flat = np.array([number[w] for f in every for w in f])
    lengths = np.array([len(f) for f in every])
    starts, times = np.cumsum(lengths) - lengths, np.repeat(np.array(list(every.values()), dtype=float), lengths)
    counts = np.zeros((len(number), len(languages)))
    for i, c in enumerate(by_label):
        counts[[number[w] for w in c], i] = list(c.values())
    model, scores, facts, letters = vocabulary.model(counts, languages)
    for i in range(rounds):
        best, lead, _, ok = judged(flat, starts, scores, facts)
        if i == 0:
            best, lead = _leads(_sums(letters[flat], starts))
        sure = np.repeat(ok & (lead >= LEAST_LEAD), lengths)
        lang = np.repeat(best, lengths)
        at = flat * len(languages) + lang
        counts = np.bincount(at[sure], weights=times[sure], minlength=counts.size).reshape(counts.shape)
        model, scores, facts, letters = vocabulary.model(counts, languages)
    return model


@dataclass
class Found:
    """Of one text: its language (None without a sentence), and ``(language, confidence, sentences)`` of each stretch."""

    lang: str | None
    confidence: float
    sentences: int
    stretches: list[tuple[str, float, int]]


def _sure(lead: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(lead, 50.0)))


def _of_sentences(languages: list[str], scored: list[tuple[int, float, float]]) -> Found:
    if not scored:
        return Found(None, 0.0, 0, [])
    sure = [s for s in scored if s[1] >= LEAST_LEAD] or scored
    now, placed = sure[0][0], []
    for lang, lead, weight in scored:
        if lead >= LEAST_LEAD:
            now = lang
        placed.append((now, _sure(lead), weight))
    number, size = Counter(p[0] for p in placed), Counter()
    for lang, _, weight in placed:
        size[lang] += weight
    best = min(number, key=lambda x: (-number[x], -size[x], x))
    stretches: list[tuple[str, float, int]] = []
    for lang, run in groupby(placed, key=lambda p: p[0]):
        sures = [p[1] for p in run]
        stretches.append((languages[lang], sum(sures) / len(sures), len(sures)))
    return Found(languages[best], sum(c for lang, c, _ in placed if lang == best) / len(placed), len(placed), stretches)


def identify_all(model: Model, texts: Iterable[str | None]) -> Iterator[Found]:
    """Languages of texts.

    The language of a text is that of most of its sentences, of equally many
    the one with more words, then the one first in the alphabet; confidence is the
    share of its sentences times how sure they are. A sentence between two
    languages goes with the sentence before it (at the start, after it).
    """
    held: list[list[str]] = []
    sizes: list[int] = []

    def judge_held() -> Iterator[Found]:
        scored, at = [s for i in range(0, len(held), AT_ONCE) for s in model.judge(held[i : i + AT_ONCE])], 0
        for size in sizes:
            yield _of_sentences(model.languages, [s for s in scored[at : at + size] if s])
            at += size
        held.clear()
        sizes.clear()

    for text in texts:
        found = [words(s) for s in sentences(text)] if text and model.languages and not text.isspace() else []
        held += found
        sizes.append(len(found))
        if len(held) >= AT_ONCE:
            yield from judge_held()
    yield from judge_held()


def identify(model: Model, text: str | None) -> Found:
    """The same for one text."""
    return next(identify_all(model, [text]))


def label_key(label: Column) -> Column:
    """A label without outer blanks and letter case."""
    return F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


#: More known forms of labels than this are an error, as they are sent to every task.
MOST_CODES = 1_000


def _codes(lang_codes: DataFrame) -> dict[str, str]:
    rows = lang_codes.select("code", "lang").where(F.col("code").isNotNull() & F.col("lang").isNotNull()).limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"more than {MOST_CODES} language codes")
    return {r.code: r.lang for r in rows}


def _labelled(documents: DataFrame, codes: dict[str, str]) -> DataFrame:
    """``documents`` with ``label_lang``, the language its label stands for; null if it stands for none."""
    names = F.create_map(*(F.lit(x) for pair in sorted(codes.items()) for x in pair)) if codes else F.expr("map('', '')")
    return documents.withColumn("label_lang", F.try_element_at(names, label_key(F.col("lang"))))


def training_sample(documents: DataFrame, codes: dict[str, str], most: int = TRAINING_DOCUMENTS) -> list[tuple[str, str]]:
    """About ``most`` distinct labelled texts with their labels' languages; the number in the whole table only sets the rate."""
    labelled = _labelled(documents.select("doc_id", "text", "lang"), codes).where(F.col("label_lang").isNotNull() & (F.length("text").between(1, LONGEST_TRAINING)))
    counts = {r[0]: r[1] for r in labelled.groupBy("label_lang").count().collect()}
    if not counts:
        return []
    each = most / len(counts)
    rates = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, each / n))))
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id", "text"), 11) / F.lit(float(1 << 53)) < F.element_at(rates, F.col("label_lang"))
    return sorted({(r.text, r.label_lang) for r in labelled.where(drawn).select("text", "label_lang").limit(2 * most).collect()})


def fitted(documents: DataFrame, lang_codes: DataFrame, most: int = TRAINING_DOCUMENTS) -> Model:
    return fit(training_sample(documents, _codes(lang_codes), most))


def _identify(get: Callable[[], Model]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get()
        for batch in batches:
            rows: list[tuple] = []
            ids, texts, labels = (c.to_pylist() for c in batch.columns)
            for doc_id, label, found in zip(ids, labels, identify_all(model, texts), strict=True):
                rows.append((doc_id, 0, found.lang, found.confidence, found.sentences, label))
                if len({s[0] for s in found.stretches}) > 1:
                    rows += [(doc_id, i, *s, label) for i, s in enumerate(found.stretches, 1)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "seg_no", "lang", "confidence", "sentences", "label_lang"])

    return run


def languages(documents: DataFrame, lang_codes: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, seg_no, lang, confidence, sentences, label_lang)``.

    ``seg_no`` 0 is one row for each row of ``documents``: the language of most of
    its sentences, null with confidence 0 for a null, empty or blank text and one
    without a sentence. Texts in several languages have further rows 1, 2, ... for
    each stretch of sentences in one language. ``label_lang`` is the language that
    the delivered label stands for, null if none. Repeated rows are kept, whole
    texts are read, other columns are not. No shuffle.
    """
    codes = _codes(lang_codes)
    model = model or fit(training_sample(documents, codes))
    # bounded by MOST_WORDS and MOST_GRAMS
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = _labelled(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang"), codes)
    return source.select("doc_id", "text", "label_lang").mapInArrow(_identify(lambda: shared.value), "doc_id bigint, seg_no int, lang string, confidence double, sentences int, label_lang string")


def found_languages(documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """``(doc_id, seg_no, lang)``: the language of documents whose label is missing or wrong, and of each stretch of mixed ones."""
    all_rows = languages(documents, lang_codes)
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang"))
    return all_rows.where(F.col("lang").isNotNull() & ((F.col("seg_no") > 0) | wrong)).select("doc_id", "seg_no", "lang")


#: The part of the documents with a known label that must agree with it, in the report.
AGREEING = 0.8


def agreement(documents: DataFrame, lang_codes: DataFrame, agreeing: float = AGREEING) -> DataFrame:
    """``(documents, labelled, agrees, ordered)``: rows with seg_no 0, those of them with a known label, whether the language found is theirs in the part ``agreeing`` of those that have a sentence, and whether the stretches of every document are numbered from 1 and differ from one to the next."""
    rows = written(languages(documents, lang_codes))
    whole, judged_too = F.col("seg_no") == 0, F.col("label_lang").isNotNull() & F.col("lang").isNotNull()
    same = F.count(F.when(whole & judged_too & (F.col("label_lang") == F.col("lang")), 1))
    totals = rows.agg(F.count(F.when(whole, 1)).alias("documents"), F.count(F.when(whole & F.col("label_lang").isNotNull(), 1)).alias("labelled"), (same >= agreeing * F.count(F.when(whole & judged_too, 1))).alias("agrees"))
    ordered = Window.partitionBy("doc_id").orderBy("seg_no")
    follows = (F.col("seg_no") == F.row_number().over(ordered)) & ~F.lag("lang").over(ordered).eqNullSafe(F.col("lang"))
    runs = rows.where(F.col("seg_no") > 0).select(follows.alias("_follows")).agg(F.coalesce(F.min("_follows"), F.lit(True)).alias("ordered"))
    return totals.crossJoin(runs)  # one row each
