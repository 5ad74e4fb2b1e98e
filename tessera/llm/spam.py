"""Problem 8: pages made of keywords, links or tags instead of sentences.

A text is read as a sequence of word classes: function words by their role, content words by
their form and by whether they were just used, links, tags, numbers, punctuation, line ends.
Trigram models of these sequences are fitted to all documents: their counts, and those of the windows
by perplexity, are summed over the tables, and only these sums, of bounded size, reach the driver. The
sequences, a byte a class, are made once and stored. What is prose is told by the texts alone, never
by their source:

1. A prose model on the documents with at least PROSE function words among their words, and few
   links. The perplexities of their windows of WINDOW classes give the bounds of what is normal:
   the lowest and highest quantiles of TAILS.
2. A model of abnormal pages. It starts from documents that are mostly links, or mostly repeated
   words with hardly any function word, or mostly of windows beyond the bounds with none, and is
   fitted again in turn with a model of all others (hard expectation maximisation, ROUNDS times).

Then every document is scored, whole: a window is abnormal if its perplexity under the prose model
is beyond the bounds, on either side, and it is better told by the model of abnormal pages; a
document is found by the share of it in such windows, or if the latter holds of it as a whole by
BITS. The second model is needed as code, logs and tables are no prose either; a perplexity that
is low because a text repeats itself does not make it prose: contexts that are rare in prose fall
back to shorter ones, and a word just used is another class than a new one.

Null, empty and blank texts are never found. Copies are counted and scored each. Without a prose
document or without an abnormal one, nothing is found. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

# Function words of the six languages, by role.
ROLES = {
    "article": "the a an this that these those each every its their his her der die das den dem des ein eine einen einem einer eines dieser diese dieses jede jeder jedes le la les un une des ce cet cette ces chaque el los las unos unas una este esta estos estas cada lo",
    "preposition": "of in on at by for with from to into after before during without until since between over under about as through against behind across von in im an am auf bei für mit aus zu zum zur nach vor während ohne bis seit zwischen über unter durch gegen de du dans sur par pour avec sans avant après pendant depuis entre sous chez jusqu en con por para sin antes después durante desde hasta sobre entre bajo del al",
    "pronoun": "i you he she it we they me him us them who which what nobody someone ich du er sie es wir ihr man niemand jemand wer was je tu il elle on nous vous ils elles qui que quoi personne yo tú él ella nosotros ustedes ellos ellas quien que nadie se",
    "verb": "is are was were be been being has have had do does did can could will would may might must should don't doesn't let ist sind war waren wird werden wurde hat haben hatte kann können muss soll est sont était étaient a ont avait peut doit fait es son era fue ha han había puede debe está están",
    "link": "and or but if because while when than then so not no nor though although unless once both either even yet also only just und oder aber wenn weil während als dann nicht kein keine obwohl sobald solange auch nur et ou mais si parce quand lorsque tant ne pas ni même aussi seulement y o pero si porque mientras cuando aunque no ni también solo",
    "question": "why how where whose warum wie wo pourquoi comment où por qué cómo dónde",
}
RUSSIAN = "и в не на что с по как это к но из у за от о для до если без при после перед пока когда или же бы все так его их она они он мы вы я был была были нет даже только"

CLASSES = ["pad", *ROLES, "ru", "kana", "word", "word_near", "word_far", "cap", "cap_near", "cap_far", "upper", "upper_near", "mixed", "mixed_near", "name", "number", "link_", "tag", "html", "stop", "comma", "colon", "semi", "bang", "pipe", "pipe_edge", "bullet", "tick", "bracket", "quote", "math", "other", "line", "para"]
C = {name: i for i, name in enumerate(CLASSES)}
K = len(CLASSES)
_FUNCTION = {word: C[role] for role, words in reversed(ROLES.items()) for word in words.split()} | dict.fromkeys(RUSSIAN.split(), C["ru"])
_REPEATABLE = {C["word"]: (C["word_near"], C["word_far"]), C["cap"]: (C["cap_near"], C["cap_far"]), C["upper"]: (C["upper_near"], C["upper_near"]), C["mixed"]: (C["mixed_near"], C["mixed_near"])}
NEAR = 12
#: Classes in a window, and fitting rounds.
WINDOW, ROUNDS = 32, 4
#: Perplexities are told to 1/STEPS of a bit.
STEPS = 1 << 14
#: Share of function words in prose and of links beyond it, and the quantiles of its perplexity that bound the normal.
PROSE, FEW_LINKS, TAILS = 0.25, 0.05, (0.002, 0.98)
#: Shares that start the abnormal class: links; repeated words with few function words; hardly any function words.
LINKS, REPEATED, FEW, HARDLY_ANY, CODE_SIGNS = 0.2, 0.45, 0.1, 0.05, 0.1
#: A document is found if more than this share of it lies in abnormal windows, or if the mean of its bits is above BITS.
SHARE, BITS = 0.35, -0.4
#: Contexts met in less than this share of all places fall back to shorter ones.
SMOOTHING = 2e-3

_TOKEN = re.compile(
    r"https?://[^\s<>\")\]|]+|</?[A-Za-z][^<>\n]*>|\n\s*\n\s*|\n[ \t]*|[#＃][^\W_][\w-]*"
    r"|[぀-ゟ]+|[゠-ヿ一-鿿々]+|\w+(?:[./:'’-]\w+)*|[^\s\w]"
).findall
_PUNCTUATION = {**dict.fromkeys(".。…", "stop"), **dict.fromkeys(",、،，", "comma"), ":": "colon", "：": "colon", ";": "semi", **dict.fromkeys("!?！？¿¡", "bang"), **dict.fromkeys("|¦", "pipe"), **dict.fromkeys("*-•·–—»›>~+▪●◦→", "bullet"), "`": "tick", **dict.fromkeys("()[]{}<", "bracket"), **dict.fromkeys("\"'“”„«‘’", "quote"), **dict.fromkeys("=%/\\&@$^_", "math")}


class _Codes(dict):
    """Token -> class + 256 * identity of the word (0 for what is no content word)."""

    def __missing__(self, token: str) -> int:
        code = self._classify(token)
        if len(self) > 500_000:
            self.clear()
        self[token] = code
        return code

    def _classify(self, token: str) -> int:
        first = token[0]
        if first == "\n":
            return C["para"] if token.count("\n") > 1 else C["line"]
        if token.startswith(("http://", "https://", "www.")):
            return C["link_"]
        if first in "#＃" and len(token) > 1:
            return C["tag"]
        if first == "<" and len(token) > 1:
            return C["html"]
        if not (first.isalnum() or first == "_"):
            return C[_PUNCTUATION.get(first, "other")]
        if "぀" <= first <= "ゟ":
            return C["kana"]
        low = token.lower()
        role = _FUNCTION.get(low)
        if role is not None:
            return role
        if "_" in token or "/" in token or "." in token or ":" in token or any(a.islower() and b.isupper() for a, b in zip(token, token[1:])):
            return C["name"]
        if first.isdigit() and not any(c.isalpha() for c in token):
            return C["number"]
        if any(c.isdigit() for c in token):
            kind = "mixed"
        elif token.isupper() and len(token) > 1:
            kind = "upper"
        elif first.isupper():
            kind = "cap"
        else:
            kind = "word"
        return C[kind] + 256 * (1 + (hash(low) & 0xFFFFFFFFFFFF))


_codes = _Codes()
NOT_BLANK = "text rlike '(?U)\\\\S'"
_NEAR_OF = np.arange(K)
_FAR_OF = np.arange(K)
for _kind, (_near, _far) in _REPEATABLE.items():
    _NEAR_OF[_kind], _FAR_OF[_kind] = _near, _far


def _classes(*names: str) -> np.ndarray:
    chosen = np.zeros(K)
    chosen[[C[n] for n in names]] = 1.0
    return chosen


_FUNCTIONS, _LINKS, _CODE = _classes(*ROLES, "ru", "kana"), _classes("link_", "tag", "html"), _classes("semi", "math", "tick")
_USED_BEFORE = _classes("word_near", "word_far", "cap_near", "cap_far", "upper_near", "mixed_near")
_ALL_WORDS = np.minimum(_FUNCTIONS + _LINKS + _USED_BEFORE + _classes("word", "cap", "upper", "mixed", "name", "number"), 1.0)


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts, one after the other, and the number of each text's classes."""
    lists = [list(map(_codes.__getitem__, _TOKEN(t))) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    codes = np.fromiter((c for x in lists for c in x), np.int64, count=int(sizes.sum()))
    kinds, words = codes & 255, codes >> 8
    breaks = (kinds == C["line"]) | (kinds == C["para"])
    beside = np.zeros(len(kinds) + 2, bool)
    beside[:-2] |= breaks
    beside[2:] |= breaks
    kinds[(kinds == C["pipe"]) & beside[1:-1]] = C["pipe_edge"]
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(words)
    if len(at):
        key = words[at] * 1_000_003 + text[at]  # wraps; words of different texts differ
        order = np.argsort(key, kind="stable")
        gap = np.full(len(at), 1 << 30)
        gap[order[1:]] = np.where(key[order[1:]] == key[order[:-1]], order[1:] - order[:-1], 1 << 30)
        new = kinds[at]
        kinds[at] = np.where(gap <= NEAR, _NEAR_OF[new], np.where(gap < 1 << 30, _FAR_OF[new], new))
    return kinds, sizes


def trigrams(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(kinds) + 2 * len(sizes), np.int64)  # each text begins with two pads
    place = np.arange(len(kinds)) + 2 * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    padded[place] = kinds
    return (padded[place - 2] * K + padded[place - 1]) * K + padded[place]


def surprises(counts: np.ndarray) -> np.ndarray:
    """-log2 p(c | a, b) of all trigrams, by interpolation of the three orders."""
    three = counts.reshape(K, K, K).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * K)
    few = 5 + SMOOTHING * one.sum()
    p2 = (two + few * p1) / (two.sum(1, keepdims=True) + few)
    p3 = (three + few * p2[None]) / (three.sum(2, keepdims=True) + few)
    return -np.log2(p3).ravel()


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window: its text, its start and its length."""
    ends, count = np.cumsum(sizes), -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    start = (ends - sizes)[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    return owner, start, np.minimum(start + WINDOW, ends[owner]) - start


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, start) if len(start) else np.zeros(0)


def _sequences(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds, prose, abnormal, bare) of every document with a text that is not blank: its classes, a
    byte each, whether it is prose, starts the abnormal class, or does so if its windows are beyond the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, sizes = classes(b["text"].to_pylist())
            texts, size = np.repeat(np.arange(len(sizes)), sizes), np.maximum(sizes, 1)
            many = lambda chosen: np.bincount(texts, chosen[kinds], len(sizes))
            words = np.maximum(many(_ALL_WORDS), 1)
            functions, links = many(_FUNCTIONS) / words, many(_LINKS) / words
            prose = (functions >= PROSE) & (links <= FEW_LINKS) & (sizes > 0)
            abnormal = ((links > LINKS) | ((functions < FEW) & (many(_USED_BEFORE) / words > REPEATED))) & (sizes > 0)
            bare = (functions < HARDLY_ANY) & (many(_CODE) / size < CODE_SIGNS) & (sizes > 0)
            ends = pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, pa.py_buffer(kinds.astype(np.uint8).tobytes())])
            yield pa.RecordBatch.from_arrays([b["doc_id"], packed, *map(pa.array, (prose, abnormal, bare))], names=["doc_id", "kinds", "prose", "abnormal", "bare"])

    texts = documents.where("text is not null").select("doc_id", "text").where(NOT_BLANK)
    return stored(texts.mapInArrow(run, "doc_id long, kinds binary, prose boolean, abnormal boolean, bare boolean"))


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigram codes of all texts, one after the other, and the number of each text's classes."""
    sizes = np.array([len(x) for x in packed.to_pylist()], dtype=np.int64)
    return trigrams(np.frombuffer(b"".join(packed.to_pylist()), np.uint8), sizes), sizes


def _flags(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b[name].to_numpy(zero_copy_only=False).astype(bool)


def _summed(frame: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of `count`, `size` numbers a batch, over a whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += count(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = frame.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return total


def _perplexity(bits: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each window, in steps."""
    return np.rint(_sums(bits[codes].astype(float), start) / np.maximum(length, 1) * STEPS).astype(np.int64)


def _quantile(counts: np.ndarray, share: float) -> float:
    """Of the places of counts, linear between neighbours."""
    ends, place = np.cumsum(counts), share * (counts.sum() - 1)
    below, above = (int(np.searchsorted(ends, x, "right")) for x in (np.floor(place), np.ceil(place)))
    return below + (above - below) * (place - np.floor(place))


def _shares(chosen: np.ndarray, owner: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text, the share in windows that are chosen."""
    return np.bincount(owner, np.where(chosen, length, 0), len(sizes)) / np.maximum(sizes, 1)


def fit(read: DataFrame) -> dict | None:
    """The prose model (bits per trigram), the bounds of its perplexity (in steps), and how many bits
    more each trigram costs under the model of normal pages than under that of abnormal ones, of all
    documents; None if either class is empty."""
    context = read.sparkSession.sparkContext
    columns = read.select("kinds", "prose", "abnormal", "bare")
    tally = lambda codes: np.bincount(codes, minlength=K**3)
    every = _summed(columns, lambda b: tally(_unpacked(b["kinds"])[0]), K**3)
    in_prose = _summed(columns.where("prose"), lambda b: tally(_unpacked(b["kinds"])[0]), K**3)
    if not in_prose.any():
        return None
    bits = context.broadcast(surprises(in_prose).astype(np.float32))
    most = int(bits.value.max() + 1) * STEPS

    def spread(b: pa.RecordBatch) -> np.ndarray:
        codes, sizes = _unpacked(b["kinds"])
        _, start, length = windows(sizes)
        return np.bincount(_perplexity(bits.value, codes, start, length), minlength=most)

    low, high = (_quantile(x, share) for x in [_summed(columns.where("prose"), spread, most)] for share in TAILS)

    def begun(b: pa.RecordBatch) -> np.ndarray:
        codes, sizes = _unpacked(b["kinds"])
        owner, start, length = windows(sizes)
        perplexity = _perplexity(bits.value, codes, start, length)
        beyond = _shares((perplexity < low) | (perplexity > high), owner, length, sizes) > 0.5
        chosen = _flags(b, "abnormal") | (beyond & _flags(b, "bare"))
        return tally(codes[np.repeat(chosen, sizes)])

    abnormal = _summed(columns, begun, K**3)
    for n in range(ROUNDS):
        if not abnormal.any() or (abnormal == every).all():
            return None
        rise = context.broadcast((surprises(every - abnormal) - surprises(abnormal)).astype(np.float32))

        def told(b: pa.RecordBatch, rise=rise) -> np.ndarray:
            codes, sizes = _unpacked(b["kinds"])
            owner, start, length = windows(sizes)
            return tally(codes[np.repeat(_shares(_sums(rise.value[codes].astype(float), start) > 0, owner, length, sizes) > 0.5, sizes)])

        if n < ROUNDS - 1:
            abnormal = _summed(columns, told, K**3)
    return {"prose": bits.value, "low": low, "high": high, "rise": rise.value}


def score(model: dict, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the share of it in abnormal windows, and the mean rise in bits."""
    owner, start, length = windows(sizes)
    perplexity = _perplexity(model["prose"], codes, start, length)
    rise = _sums(model["rise"][codes].astype(float), start)
    abnormal = ((perplexity < model["low"]) | (perplexity > model["high"])) & (rise > 0)
    return _shares(abnormal, owner, length, sizes), np.bincount(owner, rise, len(sizes)) / np.maximum(sizes, 1)


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, share, bits) of every document with a text that is not blank."""
    read = _sequences(documents)
    model = documents.sparkSession.sparkContext.broadcast(fit(read))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share, bits = np.zeros(b.num_rows), np.full(b.num_rows, -1.0)
            if model.value is not None:
                share, bits = score(model.value, *_unpacked(b["kinds"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(share), pa.array(bits)], names=["doc_id", "share", "bits"])

    return read.select("doc_id", "kinds").mapInArrow(run, "doc_id long, share double, bits double")


def spam(documents: DataFrame) -> DataFrame:
    """(doc_id) of the pages found."""
    return scored(documents).where((F.col("share") > SHARE) | (F.col("bits") > BITS)).select("doc_id")
