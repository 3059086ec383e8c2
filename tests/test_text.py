"""Cleaning, splitting and chunking of posts."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vecloom.functions.text import Chunker, FileTokenizer, WordTokenizer, chunk_counters, chunk_posts, clean, drop_unwanted, guess_language, html_text, language_of, post_text, rule_sentences, split_cjk, split_universal, truncated

CASES = [
    ("a\x00b\x1cc\td", "abc\td"),
    ("Tom &amp; Ann", "Tom & Ann"),
    ("x<script>y()</script>z", "x z"),
    ("<style>p{}</style>a<table><tr><td>b</td></tr></table>c", "a c"),
    ("see [title](http://u.v) now", "see title now"),
    ("![alt](http://u.v/x.png)end", ")end"),  # the bare image name goes first
    ("![](http://u.v/x)end", "end"),
    ("go https://u.v/x?y=1 on", "go  on"),
    ("p data:image/png;base64,AAAA= q", "p  q"),
    ("a\nPosted via App\nb", "a\n\nb"),
    ("**bold** _it_", "bold it"),
    ("plain", "plain"),
    ("", ""),
    (None, None),
]


def test_clean(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, t string")
    assert [r.c for r in df.orderBy("i").select(clean("t").alias("c")).collect()] == [b for _, b in CASES]


def test_html_text_of_broken_markup():
    assert html_text("a<b>b</i>c") == "a b c" and html_text("<table>x") == "" and html_text("1 < 2") == "1 < 2"


def test_entities_are_decoded_the_same_with_and_without_tags():
    assert html_text("&amp;lt;") == html_text("<b>&amp;lt;</b>") == "<" and html_text("&amp;amp;lt;") == html_text("<i>&amp;amp;lt;</i>") == "&lt;"


class Joining(WordTokenizer):
    """Every sentence after the first costs a token for joining it."""

    def count(self, text):
        return len(self.encode(text)) + max(0, text.count(". "))


def test_what_is_added_last_is_given_up_first():
    got = Chunker(Joining(), 12, 0.4).chunk("A b. C d. E f. G h. I j. K l. M n.").chunks
    assert got == ["A b. C d.", "E f. G h.", "I j. K l.", "K l. M n."]  # a third sentence, then the overlap is given up, the earliest first


def test_abbreviations_of_other_languages_end_no_sentence():
    for text in ("Er kommt z.B. Montag.", "Vive M. Dupont.", "El Sr. Lopez vino.", "Это г. Москва.", "Firma np. Alfa."):
        assert rule_sentences(text, "en")[0] == [text]


def test_columns(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "t string, b string")
    assert [r.x for r in df.select(post_text("t", "b").alias("x")).collect()] == [None, None] and spark.range(1).select(post_text(F.lit("a"), F.lit("b"))).first()[0] == "a.\n\nb"
    one = spark.createDataFrame([("안녕 hi. 잘 가!끝",)], "t string")
    r = one.select(split_cjk("t").alias("c"), split_universal("t").alias("u"), guess_language("t").alias("g"), truncated("t", 2).alias("s"), truncated("t", 0).alias("w")).first()
    assert r.c == ["안녕 hi.", "잘 가!", "끝"] and r.u == ["안녕 hi.", "잘 가!끝"] and r.g == "ko" and r.s == "안녕" and r.w.endswith("끝")
    assert [language_of(t) for t in ("漢字かな", "漢字", "abc", "漢字가")] == ["ja", "zh", "en", "ko"]


def test_rule_sentences():
    assert rule_sentences("Dr. A. Smith came. He left! \"Why?\" she said.", "en")[0] == ["Dr. A. Smith came.", 'He left!', '"Why?" she said.']
    assert rule_sentences("[111111 2]. Next one", "en") == (["[111111 2].", "Next one"], 1)
    assert rule_sentences("यह है। वह है।", "en")[0] == ["यह है।", "वह है।"]


T = WordTokenizer()


def test_chunker_phases():
    c = Chunker(T, 12, 0.2)
    assert (c.budget, c.fresh) == (10, 8)
    small = c.chunk("One two. Three four.")
    assert small.chunks == ["One two. Three four."] and small.token_count == 6
    got = c.chunk("A b c d e. F g h i j. K l m n o.")
    assert got.chunks == ["A b c d e.", "F g h i j.", "K l m n o."]
    over = c.chunk("a b c d e f g h i. Next one.")  # above the fresh share, within the budget
    assert over.chunks[0] == "a b c d e f g h i." and over.truncated == 0
    giant = c.chunk(" ".join("x" * 30) + ". Next one.")
    assert giant.truncated == 1 and len(T.encode(giant.chunks[0])) == 10 and giant.chunks[1].endswith("Next one.")
    assert Chunker(T, 12, 0.2, max_chunks=1).chunk("A b c d e. F g h i j.").chunks == ["A b c d e."]
    with pytest.raises(ValueError):
        Chunker(T, 3, 0.0, "a b")
    assert Chunker(T, 3, 0.0).chunk("one two three four").chunks == ["one"]  # cut to a budget of one token


def test_overlap_repeats_the_last_sentences():
    got = Chunker(T, 14, 0.5).chunk("A b. C d. E f. G h. I j. K l. M n.").chunks
    for a, b in zip(got, got[1:]):
        first = b.split(". ")[0].rstrip(".")
        assert first in a


def test_unwrapping_and_universal_split():
    c = Chunker(T, 8, 0.0)
    assert [s for s, _ in c.sentences('"A b c. D e f. G h i."')[0]] == ["A b c.", "D e f.", "G h i."]
    assert len(c.sentences("यह एक दो है। वह तीन चार है। यह पाँच छह है।")[0]) == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A b.", "Cc dd ee ff gg.", "H?", "i j k l m n o p q r s t.", "“U v. W x.”", "\n"]), max_size=25), st.integers(4, 30), st.sampled_from([0.0, 0.15, 0.5]), st.sampled_from(["", "p: "]))
def test_chunks_hold_the_limit_and_every_sentence(parts, limit, overlap, prefix):
    text = " ".join(parts)
    if limit - T.count(prefix) - T.specials <= 0:
        return
    c = Chunker(T, limit, overlap, prefix)
    done = c.chunk(text)
    assert all(T.count(x) + T.specials <= limit and x.startswith(prefix) for x in done.chunks)
    assert done.chunks == c.chunk(text).chunks
    if not done.truncated:
        joined = " ".join(done.chunks)
        assert all(s in joined for s, _ in c.sentences(text)[0])


def test_chunk_posts_and_counters(spark):
    df = spark.createDataFrame([(1, "One two. Three."), (2, None), (3, "  "), (4, "x " * 100), (5, "[111111 a]. b")], "k long, t string").withColumn("chunks", F.lit("clash"))
    out = chunk_posts(df, "k", "t", 20, 0.1, "p: ", 3)
    got = {r.k: (r.chunks, r.token_count) for r in out.collect()}
    assert got[1] == (["p: One two. Three."], 5) and got[2] == (None, 0) and got[3] == (None, 0) and got[4][1] == 100
    assert tuple(chunk_counters(out).first()) == (1, 1) and tuple(chunk_counters(out.limit(0)).first()) == (0, 0)


def test_tokenizer_file():
    P = pytest.importorskip("public_tokenizers")
    t = FileTokenizer(P.path("byte_bpe_50k.json"))
    assert t.decode(t.encode("hello world")) == "hello world" and Chunker(t, 10, 0.1).chunk("Hello there. " * 5).chunks


def test_posting_lines_end_at_line_feeds_only(spark):
    texts = ["Posted via x\u2028y\nz", "Posted via a\rb\r\nc", "**Posted via\u0085q"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    want = [re.sub(r"Posted via.*$|[*_]+", "", s, flags=re.M) for s in texts]
    assert [r.s for r in df.orderBy("i").select(drop_unwanted("s").alias("s")).collect()] == want


def test_embedding_service_in_both_protocols():
    """Against a server that answers out of order and fails at first."""
    import json
    import pickle
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    import numpy as np

    from vecloom.functions.embed import EmbeddingService, Retrying

    asked, failures = [], [1]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            if failures:
                failures.pop()
                self.send_error(503)
                return
            vectors = [[float(len(t)), 1.0] for t in body["input"]]
            if body["model"] == "short":
                vectors = vectors[1:]
            answer = {"embeddings": vectors} if self.path == "/api/embed" else {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}/"
        for protocol in ("list", "indexed"):
            call = pickle.loads(pickle.dumps(Retrying(EmbeddingService(at, "m", protocol, {"n": 1}), None, 0.01)))
            assert np.array_equal(call(["a", "bbb"]), [[1, 1], [3, 1]]) and len(call([])) == 0
        assert [p for p, _ in asked] == ["/api/embed", "/api/embed", "/v1/embeddings"] and asked[0][1]["options"] == {"n": 1} and "options" not in asked[2][1]
        with pytest.raises(ValueError):
            Retrying(EmbeddingService(at, "short"))(["a", "b"])
        failures += [1, 1]
        with pytest.raises(OSError):
            Retrying(EmbeddingService(at, "m"), 2, 0.01)(["a"])
    finally:
        server.shutdown()
