"""Cleaning and splitting of posts.

Regular expressions run in the JVM; only the HTML parser and the chunker need Python and get whole Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Patterns of the cleaner, in the order they apply.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LINK_TITLES = r"(?i)\[([^\]]+)\]\([^\)]+\)|!\[\]\([^)]*\)|!\S+\.(?:jpg|jpeg|png|gif)"
IMAGES_URLS = r"(?i)(?:!\[.*?\]\(.*?\)|https?://\S+)"
BASE64 = r"data:image\/[a-zA-Z]+;base64,[A-Za-z0-9+/=]+"
UNWANTED = r"(?md)Posted via.*$|[*_]+"
# Scripts that settle the language, tested in this order.
KOREAN, JAPANESE, CHINESE = r"[가-힯]", r"[぀-ゟ゠-ヿ]", r"[一-鿿]"
# Sentence ends of the plain splitters.
CJK_END = r"(?<=[。？！…\.?!])\s*|\r?\n+"
UNIVERSAL_END = r"(?<=[。？！।॥۔؟։።။។])\s*|(?<=[\.?!…])\s+|\r?\n+"
DIGIT_BRACKET = r"\[[^\]]*\d{5,}[^\]]*\]"
# Tags dropped with their content.
DROPPED = frozenset(("script", "style", "img", "table"))
# HTML elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside: list[str] = []
        self.joined = False  # the last event was text too

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.joined = False
        if tag in DROPPED and tag not in VOID:
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.joined = False
        if tag in self.inside:
            while self.inside and self.inside.pop() != tag:
                pass

    def handle_comment(self, data: str) -> None:
        self.joined = False

    def handle_data(self, data: str) -> None:
        if self.inside or not data:
            return
        if self.joined:
            self.parts[-1] += data
        else:
            self.parts.append(data)
        self.joined = True


def html_text(text: str) -> str:
    """Text of an HTML fragment without scripts, styles, images and tables, its pieces joined by a space.

    Entities are decoded once before the tags are read and once with them, whether or not there are any.
    """
    text = html.unescape(text)
    if "<" not in text:
        return html.unescape(text)
    parser = _Text()
    parser.feed(text)
    parser.close()
    return " ".join(parser.parts)


@F.pandas_udf(StringType())
def strip_html(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html_text(t))


@F.pandas_udf(StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_control(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), CONTROL, "")


def link_titles(c: Column | str) -> Column:
    """A link becomes its title; empty images and bare image names go."""
    return F.regexp_replace(_c(c), LINK_TITLES, "$1")


def drop_images_urls(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), IMAGES_URLS, "")


def drop_base64(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), BASE64, "")


def drop_unwanted(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), UNWANTED, "")


def collapse(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def clean(c: Column | str) -> Column:
    """A post without control characters, markup, links, images, inline data and posting lines. Null stays null.

    The HTML parser is entered only by texts that hold a tag or an entity; all else stays in the JVM.
    """
    bare = strip_control(c)
    parsed = F.when(bare.rlike(r"[<&]"), strip_html(bare)).otherwise(bare)
    return drop_unwanted(drop_base64(drop_images_urls(link_titles(parsed))))


def guess_language(c: Column | str) -> Column:
    t = _c(c)
    return F.when(t.rlike(KOREAN), "ko").when(t.rlike(JAPANESE), "ja").when(t.rlike(CHINESE), "zh").when(t.isNotNull(), "en")


def split_cjk(c: Column | str) -> Column:
    return F.filter(F.split(_c(c), CJK_END), lambda x: F.length(x) > 0)


def split_universal(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(c), UNIVERSAL_END), collapse), lambda x: F.length(x) > 0)


def post_text(title: Column | str, body: Column | str) -> Column:
    """Title, full stop, blank line, body; null if either is missing."""
    return F.concat(_c(title), F.lit(".\n\n"), _c(body))


def truncated(body: Column | str, n: int) -> Column:
    return _c(body) if n == 0 else F.substring(_c(body), 1, n)


def post_url(host: str, author: Column | str, permlink: Column | str) -> Column:
    return F.concat(F.lit(host.rstrip("/") + "/@"), _c(author), F.lit("/"), _c(permlink))


# -- tokens ----------------------------------------------------------------------------------------------------
class WordTokenizer:
    """Deterministic tokens: words, and every other visible character. Stands in where no tokenizer file is given."""

    specials = 2
    _token = re.compile(r"\w+|[^\w\s]")

    def encode(self, text: str) -> list[str]:
        return self._token.findall(text)

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, tokens: Sequence[str]) -> str:
        return " ".join(tokens)


class FileTokenizer:
    """A tokenizer definition file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._t.no_truncation()
        self.specials = self._t.num_special_tokens_to_add(False)

    def encode(self, text: str) -> list[int]:
        return self._t.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def decode(self, tokens: Sequence[int]) -> str:
        return self._t.decode(list(tokens)).strip()


@lru_cache(maxsize=4)
def tokenizer(path: str | None):
    """Once a worker."""
    return FileTokenizer(path) if path else WordTokenizer()


# -- sentences and chunks --------------------------------------------------------------------------------------
_SPACE = re.compile(r"\s+")
_RULES = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+(?=[\"'“‘(\[¿¡]?[^\W\d_a-z])|(?<=[。？！।॥۔؟])[」』”]?\s*|\r?\n+")
_CLOSED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»|\([^()\n]*\)|\[[^\[\]\n]*\]')
# Abbreviations that end no sentence, by language.
ABBREVIATIONS = """
en Mr Mrs Ms Dr Prof St No vs etc e.g i.e approx Fig Vol Jr Sr Inc Ltd Gen Col Capt Lt Sgt Rev Hon
de Hr Fr Nr bzw z.B d.h u.a usw vgl evtl ggf inkl ca Abs Str Dipl Ing
fr M MM Mme Mlle p.ex c.-à-d env av etc chap fig
es Sr Sra Srta Dr Dra Ud Uds p.ej núm pág etc aprox
it Sig Sig.ra Dott Prof Avv ecc pag es
pt Sr Sra Dr Dra p.ex etc pág núm
nl dhr mevr bijv enz o.a d.w.z blz
pl np tzn itd itp ul dr prof mgr inż
ru т.е т.д т.п г ул им проф стр рис
uk т.д т.п ім вул проф стор рис
bg т.н т.е и.др г ул проф
sk napr t.j atď č str ul
da f.eks bl.a osv ca nr
el π.χ κ κα δηλ κ.λπ
hy օր և.այլն
kk т.б б.ж
tr vb Dr Prof örn bkz Sn
hi डॉ श्री सुश्री प्रो
mr डॉ श्री
"""
_WORDS = sorted({re.escape(w) for line in ABBREVIATIONS.split("\n") for w in line.split()[1:]}, key=lambda w: (-len(w), w))
_ABBREVIATED = re.compile(r"(?:(?<!\w)(?:" + "|".join(_WORDS) + r")|\b[^\W\d_a-z])\.$")
_UNIVERSAL, _CJK, _DIGITS = re.compile(UNIVERSAL_END), re.compile(CJK_END), re.compile(DIGIT_BRACKET)
_PAIRS = (('"', '"'), ("“", "”"), ("'", "'"), ("(", ")"), ("[", "]"))
_KO, _JA, _ZH = (re.compile(p) for p in (KOREAN, JAPANESE, CHINESE))


def language_of(text: str) -> str:
    return "ko" if _KO.search(text) else "ja" if _JA.search(text) else "zh" if _ZH.search(text) else "en"


def rule_sentences(text: str, language: str) -> tuple[list[str], int]:
    """Sentences of a text and the number of fallbacks to the universal splitter (bracketed long digit runs)."""
    if language == "ko":
        return [p for p in _CJK.split(text) if p], 0
    if _DIGITS.search(text):
        return [p for p in _UNIVERSAL.split(text) if p], 1
    closed = [m.span() for m in _CLOSED.finditer(text)]
    out, start, k = [], 0, 0
    for m in _RULES.finditer(text):
        while k < len(closed) and closed[k][1] <= m.start():
            k += 1
        if k < len(closed) and closed[k][0] < m.start() and m.end() < closed[k][1]:
            continue  # quotations and parentheses stay whole
        piece = text[start : m.start()]
        tail = m.group().rstrip()
        if "\n" not in m.group() and _ABBREVIATED.search(piece):
            continue
        out.append(piece + tail)
        start = m.end()
    out.append(text[start:])
    return [p for p in out if p.strip()], 0


@dataclass
class Chunked:
    chunks: list[str]
    token_count: int
    truncated: int = 0
    fallbacks: int = 0


class Chunker:
    """Token-budgeted overlapping chunks of whole sentences.

    A chunk first takes new sentences up to the budget less the overlap, then the previous chunk's last sentences as far as
    the whole budget allows, then further new ones. Joining may need more tokens than its sentences, so the finished text is counted
    and gives up sentences until it fits, those added last first: the further ones, the overlap from its earliest
    on, and last those of the first step but one. New ones that were given up come again in the next chunk.
    """

    def __init__(self, tok, max_tokens: int, overlap: float, prefix: str = "", max_chunks: int | None = None):
        self.tok, self.prefix, self.max_chunks, self.max_tokens = tok, prefix, max_chunks, max_tokens
        self.budget = max_tokens - tok.count(prefix) - tok.specials
        if self.budget <= 0:
            raise ValueError("prefix and special tokens leave no room for content")
        self.fresh = int(self.budget * (1 - overlap))

    def sentences(self, text: str) -> tuple[list[tuple[str, int]], int]:
        """Normalised sentences with their tokens. One over the budget is unwrapped from its quotes or brackets, else split anywhere a script ends sentences, else kept."""
        language = language_of(text)
        raw, fallbacks = rule_sentences(text, language)
        out: list[tuple[str, int]] = []
        for s in raw:
            s = _SPACE.sub(" ", s).strip()
            if not s:
                continue
            n = self.tok.count(s)
            parts: list[str] = []
            if n > self.budget:
                pair = next(((a, b) for a, b in _PAIRS if len(s) > 1 and s.startswith(a) and s.endswith(b)), None)
                if pair:
                    parts, more = rule_sentences(s[1:-1], language)
                    fallbacks += more
                else:
                    parts = _UNIVERSAL.split(s)
                    if len(parts) < 2:
                        parts = []
            if not parts:
                out.append((s, n))
                continue
            for p in parts:
                p = _SPACE.sub(" ", p).strip()
                if p:
                    out.append((p, self.tok.count(p)))
        return out, fallbacks

    def _fits(self, sentences: list[str]) -> bool:
        return self.tok.count(self.prefix + " ".join(sentences)) + self.tok.specials <= self.max_tokens

    def chunk(self, text: str) -> Chunked:
        sentences, fallbacks = self.sentences(text)
        done = Chunked([], sum(n for _, n in sentences), 0, fallbacks)
        at, before = 0, []
        while at < len(sentences) and (self.max_chunks is None or len(done.chunks) < self.max_chunks):
            new: list[tuple[str, int]] = []
            used = 0
            while at + len(new) < len(sentences):
                s, n = sentences[at + len(new)]
                if used + n > self.fresh:
                    if not new:  # the first is taken whole if it fits at all, or cut to the budget
                        if n > self.budget:
                            s = self.tok.decode(self.tok.encode(s)[: self.budget])
                            n = min(n, self.budget)
                            done.truncated += 1
                        new.append((s, n))
                        used = n
                    break
                new.append((s, n))
                used += n
            old: list[tuple[str, int]] = []
            for s, n in reversed(before):
                if used + n > self.budget:
                    break
                old.insert(0, (s, n))
                used += n
            more: list[tuple[str, int]] = []
            while at + len(new) + len(more) < len(sentences) and used + sentences[at + len(new) + len(more)][1] <= self.budget:
                more.append(sentences[at + len(new) + len(more)])
                used += more[-1][1]
            while not self._fits([s for s, _ in old + new + more]):
                if more:
                    more.pop()
                elif old:
                    old.pop(0)
                elif len(new) > 1:
                    new.pop()
                else:
                    s, n = new[0]
                    tokens = self.tok.encode(s)
                    if len(tokens) <= 1:
                        break
                    new[0] = (self.tok.decode(tokens[:-1]), len(tokens) - 1)
            new += more
            at += len(new)
            before = old + new
            done.chunks.append(self.prefix + " ".join(s for s, _ in before))
        return done


def chunk_posts(posts: DataFrame, key: str, text: str, max_tokens: int, overlap: float, prefix: str = "", threshold: int = 0, max_chunks: int | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """(key, chunks, token_count, truncated, fallbacks) for every row.

    chunks is null for null, blank and too short texts (fewer tokens than the threshold); their token_count is
    kept (0 for none), so that short posts still drive deletions. The count is of the sentences, without prefix, before truncation.
    """
    kind = posts.schema[key].dataType.simpleString()
    rows = posts.select(F.col(key).alias(key), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Chunker(tokenizer(tokenizer_path), max_tokens, overlap, prefix, max_chunks)
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            done = [make.chunk(t) if t and t.strip() else Chunked([], 0) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([d.chunks if d.chunks and d.token_count >= threshold else None for d in done], pa.list_(pa.string())),
                    pa.array([d.token_count for d in done], pa.int32()), pa.array([d.truncated for d in done], pa.int32()), pa.array([d.fallbacks for d in done], pa.int32()),
                ],
                [key, "chunks", "token_count", "truncated", "fallbacks"],
            )

    return rows.mapInArrow(run, f"{key} {kind}, chunks array<string>, token_count int, truncated int, fallbacks int")


def chunk_counters(chunked: DataFrame) -> DataFrame:
    """One row: (truncated, fallbacks) over all posts."""
    return chunked.agg(F.coalesce(F.sum("truncated"), F.lit(0)).alias("truncated"), F.coalesce(F.sum("fallbacks"), F.lit(0)).alias("fallbacks"))


def splitter(kind: str) -> Callable[[Column | str], Column]:
    return {"cjk": split_cjk, "universal": split_universal}[kind]
