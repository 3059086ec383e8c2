"""Languages of documents and of their mixed-language segments.

Language-bitmask n-gram filters: a bit-sliced Bloom filter returns for an n-gram the bit mask of all languages that
contain it. The masks of a sentence's n-grams give a count per language, which is corrected for the filter's false positives. The
best sequence of languages over the sentences, with a cost for a change, makes the segments.

The filter is fitted on a bounded sample of labelled rows (``per_label`` documents a label, of at most ``max_chars``
characters each); wrong labels in it are found by leave-one-out self-training before the n-grams are taken, and which
languages exist is decided by what the documents of each class bear, weighed by the counts of all labels.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .sentences import sentence_ends

# ISO 639-1 code, 639-2/3 codes, English names.
LANGUAGES = """
af afr afrikaans|ar ara arb arabic|az aze azerbaijani|be bel belarusian|bg bul bulgarian|bn ben bengali|ca cat catalan|cs ces cze czech|da dan danish
de deu ger german|el ell gre greek|en eng english|es spa spanish castilian|et est estonian|eu eus baq basque|fa fas per persian farsi|fi fin finnish
fr fra fre french|gl glg galician|he heb hebrew|hi hin hindi|hr hrv croatian|hu hun hungarian|hy hye armenian|id ind indonesian|is isl icelandic|it ita italian
ja jpn japanese|ka kat georgian|kk kaz kazakh|ko kor korean|lt lit lithuanian|lv lav latvian|mk mkd macedonian|mr mar marathi|ms msa may malay|nb nob
nl nld dut dutch flemish|nn nno|no nor norwegian|pl pol polish|pt por portuguese|ro ron rum romanian|ru rus russian|sk slk slo slovak|sl slv slovenian
sq sqi albanian|sr srp serbian|sv swe swedish|sw swa swahili|ta tam tamil|te tel telugu|th tha thai|tl tgl fil tagalog filipino|tr tur turkish
uk ukr ukrainian|ur urd urdu|vi vie vietnamese|zh zho chi cmn chinese mandarin
"""
CODES = {name: entry.split()[0] for entry in LANGUAGES.replace("\n", "|").split("|") if entry.strip() for name in entry.split()}
# Labels that say nothing.
ABSENT = ("", "n/a", "na", "none", "null", "nil", "unknown", "unk", "?", "??", "???", "-", "--", "und", "undefined", "undetermined", "mul", "mis", "zxx", "xx", "other", "any")

SIZES = (3, 4)
HASHES = 3
SWITCH = 5.0
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def label_code(label: Column | str) -> Column:
    """ISO 639-1 code of a label in any spelling; '' for an absent one; the bare word itself for one that isn't known."""
    c = F.lower(F.regexp_replace(F.coalesce(F.col(label) if isinstance(label, str) else label, F.lit("")), r"^[\s ]+|[\s ]+$", ""))
    base = F.regexp_extract(c, r"^[^\s_(\-.@]+", 0)
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CODES.items()))
    return F.when(c.isin(*ABSENT), F.lit("")).otherwise(F.coalesce(F.try_element_at(table, base), c))


_FENCE = regex.compile(r"(?ms)^\s*(```|~~~).*?(?:^\s*\1[^\n]*$|\Z)")
#: (what a text must hold for the pattern to matter, pattern, replacement)
_STRIP = [
    (("osted", "OSTED"), regex.compile(r"(?i)^\W*posted\s+(?:via|with|from|using)\b.*$", regex.M), " "),
    (("<",), regex.compile(r"<(?:script|style)\b.*?</(?:script|style)>", regex.I | regex.S), " "),
    (("<",), regex.compile(r"</?[A-Za-z|!][^<>\n]{0,200}>"), " "),
    (("](",), regex.compile(r"!\[[^\]\n]*\]\([^)\n]*\)"), " "),
    (("](",), regex.compile(r"\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (("://", "www."), regex.compile(r"(?:https?://|www\.)[^\s<>\p{Han}\p{Hiragana}\p{Katakana}]+"), " "),
    (("data:",), regex.compile(r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]+"), " "),
    (("`",), regex.compile(r"`[^`\n]*`"), " "),
    (("@", "#"), regex.compile(r"(?<!\w)[@#][\w./\-]+"), " "),
    (("*", "_", "~", "#", ">"), regex.compile(r"[*_~]{2,}|^\s*(?:#{1,6}|>)\s+", regex.M), ""),
]
_LETTERS = regex.compile(r"[^\p{L}\p{M}'’\n]+")
_THAI_RUN = regex.compile(r"\p{Thai}{8}")
_FINAL = regex.compile(r"[.!?…。！？｡．؟۔।॥][\"'’”»“)\]）」』\s\p{Emoji_Presentation}️‍\U0001F3FB-\U0001F3FF❤]*$")
_ACCENTS = regex.compile("[̀-ͯ]")


def plain(text: str) -> str:
    """The text without markup, code, links, tags and posting lines; line breaks stay."""
    if "&" in text:
        text = html.unescape(text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    for needed, pattern, by in _STRIP:
        if any(n in text for n in needed):
            text = pattern.sub(by, text)
    return text


def fold(text: str) -> str:
    """Letters in lower case without accents, words parted by one space; line feeds stay."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", text)))
    return _LETTERS.sub(" ", text)


def units(text: str | None) -> list[tuple[str, bool]]:
    """(folded unit, is a whole sentence) of a text, in order."""
    if not text:
        return []
    text = plain(text)
    raw, start = [], 0
    for end in sentence_ends(text):
        raw.append(text[start:end].replace("\n", " "))
        start = end
    folded = [f.strip() for f in fold("\n".join(raw)).split("\n")]  # at once: a unit holds no line feed
    return [(f, bool(_FINAL.search(r)) or bool(_THAI_RUN.search(r))) for r, f in zip(raw, folded) if f]


def _ngrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the parts, and the part of each."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    joined = "\x00".join(f" {p} " for p in parts)
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.cumsum(c == 0)
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(c) < n:
                continue
            h = np.zeros(len(c) - n + 1, np.uint64)
            zero = np.zeros(len(h), bool)
            for j in range(n):
                part = c[j : len(c) - n + 1 + j]
                h = h * np.uint64(0x100000001B3) + part + np.uint64(n)
                zero |= part == 0
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            hashes.append(h[~zero])
            owners.append(owner[: len(h)][~zero])
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class Filter:
    """Bit-sliced Bloom filter: one row of language bits per hash position."""

    languages: list[str]
    rows: np.ndarray
    false: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.rows) - 1)
        out = None
        with np.errstate(over="ignore"):
            for p in _PRIMES[:HASHES]:
                got = self.rows[((h * p) >> np.uint64(20)) & size]
                out = got if out is None else out & got
        return out

    def counts(self, h: np.ndarray, owner: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per part: n-grams, and corrected count of each language."""
        n = np.bincount(owner, minlength=parts).astype(np.float64)
        width = -(-len(self.languages) // 8)
        bits = np.unpackbits(self.masks(h).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width], axis=1, bitorder="little")
        on = np.flatnonzero(bits.view(np.bool_))
        wide = 8 * width
        hits = np.bincount(owner[on // wide] * wide + on % wide, minlength=parts * wide).reshape(parts, wide)[:, : len(self.languages)].astype(np.float64)
        return n, np.maximum(0, (hits - n[:, None] * self.false) / (1 - self.false))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) != 0]


def _frequencies(group: np.ndarray, gram: np.ndarray, language: np.ndarray, classes: int, grams: int) -> np.ndarray:
    """(gram, language): groups of the language that have the gram. language: that of each group, below 0 for none."""
    held = _distinct(group.astype(np.int64) * grams + gram)
    lang = language[held // grams]
    held, lang = held[lang >= 0], lang[lang >= 0]
    return np.bincount(held % grams * classes + lang, minlength=grams * classes).reshape(grams, classes).astype(np.float32)


def _filter(grams: np.ndarray, df: np.ndarray, n: np.ndarray, names: list[str], share: float) -> Filter:
    """From (gram, language) frequencies: an n-gram belongs to a language if at least two documents
    have it and its rate there is at least ``share`` of its highest rate anywhere. n: documents of each language."""
    if len(names) > 64:
        raise ValueError("more than 64 languages")
    rate = df / np.maximum(n, 1).astype(np.float32)
    inside = (df >= 2) & (rate >= share * rate.max(1)[:, None]) & (rate >= 0.005)
    mask = np.zeros(len(grams), np.uint64)
    for i in range(len(names)):
        mask |= inside[:, i].astype(np.uint64) << np.uint64(i)
    used = mask > 0
    rows = np.zeros(1 << max(10, int(np.ceil(np.log2(max(1, int(used.sum())) * 8)))), np.uint64)
    with np.errstate(over="ignore"):
        for p in _PRIMES[:HASHES]:
            np.bitwise_or.at(rows, ((grams[used] * p) >> np.uint64(20)) & np.uint64(len(rows) - 1), mask[used])
    false = np.array([np.mean((rows >> np.uint64(i)) & np.uint64(1)) ** HASHES for i in range(len(names))])
    return Filter(names, rows, false)


def _settle_labels(given: np.ndarray, held: np.ndarray, cut: np.ndarray, grams: int, classes: int, rounds: int, least: int, weight: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Leave-one-out self-training: each document's language, and the languages that exist.

    held[cut[i]:cut[i + 1]]: the n-grams of document i. Documents gather in classes by their n-grams. A class is then
    named by the label that most of its documents bear, each counting for as many documents of the corpus as it stands for
    (``weight``): a few documents under a wrong label of their own draw the documents of the true language into one class with
    them, and that class bears the true name. A label that names no class makes no language; how many of
    its own documents bear it out doesn't matter.
    """
    now = given.copy()
    size = np.diff(cut)
    df = np.bincount(held * classes + np.repeat(now, size), minlength=grams * classes).reshape(grams, classes).astype(np.float32)
    for _ in range(rounds):
        n = np.bincount(now, minlength=classes).astype(np.float32)
        score = np.log(np.maximum(df / (n + 6), 0.02))  # a class of few documents knows little
        new = now.copy()
        for i, c in enumerate(now.tolist()):
            at = held[cut[i] : cut[i + 1]]
            total = score[at].sum(0)
            total[c] = np.log(np.maximum((df[at, c] - 1) / (n[c] + 5), 0.02)).sum()  # without the document itself
            total[n - (np.arange(classes) == c) < 1] = -np.inf
            if np.isfinite(total).any():
                new[i] = int(total.argmax())
        moved = np.flatnonzero(new != now)
        if not len(moved):
            break
        for i in moved.tolist():
            at = held[cut[i] : cut[i + 1]]
            df[at, now[i]] -= 1
            df[at, new[i]] += 1
        now = new
    borne = np.zeros((classes, classes))
    np.add.at(borne, (now, given), weight)
    language = borne.argmax(1)[now]
    size = np.bincount(language, minlength=classes)
    return language, [int(L) for L in np.argsort(-size, kind="stable") if size[L] >= least]


def build_filter(labelled: list[tuple[str, str]], rounds: int = 4, least: int = 3, totals: dict[str, int] | None = None) -> Filter:
    """labelled: (code, text). totals: documents of each code in the corpus, where the sample isn't all of it.

    Repeated texts count once. A first filter from whole documents tells the sentences of mixed documents apart; the
    final ones are taken from each document's sentences in the language.
    """
    nothing = Filter([], np.zeros(1, np.uint64), np.zeros(0))
    docs = [(c, u) for c, t in sorted(set(labelled)) if (u := units(t))]
    if not docs:
        return nothing
    names = sorted({c for c, _ in docs})
    given = np.array([names.index(c) for c, _ in docs])
    weight = np.array([max(1, (totals or {}).get(c, 0) / n) for c, n in zip(names, np.bincount(given))])[given]
    texts = [us for _, us in docs]
    h, owner = _ngrams([u for us in texts for u, _ in us])
    grams, gram = np.unique(h, return_inverse=True)
    doc = np.repeat(np.arange(len(docs)), [len(us) for us in texts])  # of each unit
    held = _distinct(doc[owner] * len(grams) + gram)
    cut = np.searchsorted(held, np.arange(len(docs) + 1) * len(grams))
    now, kept = _settle_labels(given, held % len(grams), cut, len(grams), len(names), rounds, least, weight)
    if not kept:
        return nothing
    place = np.full(len(names), -1)
    place[kept] = np.arange(len(kept))
    names, now = [names[L] for L in kept], place[now]
    count = lambda langs: np.bincount(langs[langs >= 0], minlength=len(names))
    flt = _filter(grams, _frequencies(doc[owner], gram, now, len(names), len(grams)), count(now), names, 0.4)
    for _ in range(2):
        found = np.concatenate(_segments(flt, texts, h, owner, True, 3 * SWITCH)).astype(np.int64)  # only what is clear
        part, group = np.unique(doc * (len(names) + 1) + found + 1, return_inverse=True)  # a document's units in one language
        langs = part % (len(names) + 1) - 1
        if not (langs >= 0).any():
            break
        flt = _filter(grams, _frequencies(group[owner], gram, langs, len(names), len(grams)), count(langs), names, 0.15)
    return flt


def segments(flt: Filter, docs: list[list[tuple[str, bool]]]) -> list[list[tuple[str, float, int]]]:
    """Per document (language, confidence, sentences) of each longest stretch in one language."""
    return _segments(flt, docs, *_ngrams([u for d in docs for u, _ in d]))


def _segments(flt: Filter, docs: list[list[tuple[str, bool]]], h: np.ndarray, owner: np.ndarray, by_unit: bool = False, switch: float = SWITCH) -> list[list]:
    """``segments`` from the n-grams of all units.

    by_unit: instead the index of the language of each unit, -1 for those without a say.
    """
    parts = sum(map(len, docs))
    if not parts or not flt.languages:
        return [[-1] * len(d) if by_unit else [] for d in docs]
    n, hits = flt.counts(h, owner, parts)
    share = np.minimum(hits / np.maximum(n, 1)[:, None], 1)
    clear = (share.max(1) >= 0.3) & (n >= 3)
    cost = -n[:, None] * np.log(share + 0.03)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    whole = np.fromiter((w for d in docs for _, w in d), bool, parts) & clear
    voters = np.flatnonzero(np.where((np.bincount(doc, whole, minlength=len(docs)) > 0)[doc], whole, clear))
    out: list = [np.full(len(d), -1) for d in docs] if by_unit else [[] for _ in docs]
    if not len(voters):
        return out
    first = np.flatnonzero(np.diff(doc[voters], prepend=-1))  # of each document that has voters
    count = np.diff(first, append=len(voters))
    total = np.add.reduceat(cost[voters], first, axis=0)
    best = total.argmin(1)
    rows = np.arange(len(first))
    one = total[rows, best] <= np.add.reduceat(cost[voters].min(1), first) + switch  # no path with a change costs less
    sure = _confidence(np.add.reduceat(share[voters] * n[voters, None], first, axis=0) / np.add.reduceat(n[voters], first)[:, None], best)
    start = np.r_[0, np.cumsum([len(d) for d in docs])]
    for d, k, same, c, at, size in zip(doc[voters[first]].tolist(), best.tolist(), one.tolist(), sure.tolist(), first.tolist(), count.tolist()):
        mine = voters[at : at + size]
        langs = np.full(size, k) if same else _path(cost[mine], switch)
        if by_unit:
            out[d][mine - start[d]] = langs
        elif same:
            out[d] = [(flt.languages[k], round(c, 4), size)]
        else:
            out[d] = _stretches(langs, share[mine], n[mine], flt.languages)
    return out


def _confidence(weight: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Share of the n-grams in language k, times its lead over the next language."""
    rows = np.arange(len(k))
    top = weight[rows, k]
    weight[rows, k] = 0
    return np.maximum(0, (top - weight.max(1)) / np.maximum(top, 1e-9)) * top


def _path(cost: np.ndarray, switch: float) -> np.ndarray:
    """The cheapest language of each sentence, a change costing ``switch``."""
    best, back = cost[0].copy(), []
    for row in cost[1:]:
        k = int(best.argmin())
        stay = best <= best[k] + switch
        back.append(np.where(stay, np.arange(len(best)), k))
        best = np.where(stay, best, best[k] + switch) + row
    lang = [int(best.argmin())]
    for b in reversed(back):
        lang.append(int(b[lang[-1]]))
    return np.array(lang[::-1])


def _stretches(lang: np.ndarray, share: np.ndarray, n: np.ndarray, names: list[str]) -> list[tuple[str, float, int]]:
    first = np.flatnonzero(np.diff(lang, prepend=-1))
    sure = _confidence(np.add.reduceat(share * n[:, None], first, axis=0) / np.add.reduceat(n, first)[:, None], lang[first])
    return [(names[i], round(c, 4), size) for i, c, size in zip(lang[first].tolist(), sure.tolist(), np.diff(first, append=len(lang)).tolist())]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 150, max_chars: int = 20000) -> Filter:
    """The filter from at most per_label labelled documents a label, chosen by hash of the key, same on every run.

    How many documents bear a label is counted over all of them.
    """
    known = sorted(set(CODES.values()))
    labelled = docs.select(label_code(label).alias("code"), F.col(text).alias("text"), F.col(key).alias("_key")).filter(F.col("code").isin(*known))
    totals = {r.code: r.n for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a known code
    rows = labelled.filter(F.col("text").isNotNull() & F.length("text").between(20, max_chars)).select("code", "text", F.xxhash64("_key").alias("h"))
    some = rows.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("h", "text"))).filter(F.col("n") <= per_label)
    return build_filter([(r.code, r.text) for r in some.select("code", "text").collect()], totals=totals)


def document_languages(spark: SparkSession, docs: DataFrame, flt: Filter, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, label_code, seg_no, lang, confidence, sentences): the stretches of every document.

    Null, empty and blank texts and texts without words of a known language have no row. Units without a final mark
    (headings, fragments) have a say only where a text has no whole sentence. Repeated rows stay repeated.
    """
    held = spark.sparkContext.broadcast(flt)  # at most 64 languages x bounded sample
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias(key), label_code(label).alias("label_code"), F.col(text).alias("_text")).filter("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flt = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = segments(flt, [units(t) for t in part.column(2).to_pylist()])
                take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
                flat = [(k, *s) for f in found for k, s in enumerate(f)]
                cols = list(zip(*flat)) if flat else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32()), pa.array([len(found[i]) for i in take.to_pylist()], pa.int32())],
                    [key, "label_code", "seg_no", "lang", "confidence", "sentences", "n_segments"],
                )

    return rows.mapInArrow(run, f"{key} {kind}, label_code string, seg_no int, lang string, confidence double, sentences int, n_segments int")


def relabelled(spark: SparkSession, docs: DataFrame, flt: Filter | None = None) -> DataFrame:
    """The stretches of documents whose label is absent or wrong, or that mix languages."""
    flt = flt or fit(docs)
    return document_languages(spark, docs, flt).filter((F.col("n_segments") > 1) | (F.col("label_code") != F.col("lang")))
