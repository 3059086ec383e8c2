"""Sentence boundaries."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vecloom.llm.sentences import sentence_ends, split_sentences


def parts(text):
    out, a = [], 0
    for b in sentence_ends(text):
        out.append(text[a:b].strip())
        a = b
    return out


CASES = [
    ["The hut opens at 18 a.m.", "Our guide walks."],
    ["At 15 p.m. Gribamal still waited for the bus.", "Next."],
    ["Dr. Thu measured 26.94 metres of rope at 13 p.m.", "What a view!"],
    ['He said, "Wait here. The boat is late." and left.', "The end."],
    ['"Nobody comes. Not even the fox!" whispered Thuwy.', "He ran."],
    ['"Nadie viene. ¡Ni siquiera el zorro!", susurró Grifen.', "¿Quién lo hubiera pensado?"],
    ["„Niemand kommt. Nicht einmal der Fuchs!“, flüsterte Nuba.", "Die Hütte öffnet um 19.30 Uhr, d. h. viel zu spät."],
    ["« Personne ne vient. Pas même le renard ! » a murmuré Linvel.", "Quelle vue !"],
    ['"A young potter measures the river."', "Kest said hello."],
    ["We saw gulls, crabs, seals, etc.", "The street musician repairs."],
    ["We packed rope, tape, etc. in one bag.", "Yes."],
    ["Am 3. Oktober kostet die Karte 20.1800,50 Taler.", "Der 2. Platz ging an Fr. Kiwy und Hrn. Dobas."],
    ["La casa está en la Av. Grigri, núm. 16.", "El Dr. Malnik y la Sra. Grisor midieron aprox. 33,28 metros."],
    ["J. K. Wygri paid 18,1200.50 tokens.", "The U.K.-style plug in hut no. 4 is broken."],
    ["It takes approx. 23 min. by tram or 2 hrs. on foot.", "See fig. 9 and vol. 23 for the map."],
    ["The file photo_18.final.jpg is too dark...", "Read more at https://blog.example.invalid/p18?ref=a.b before you go."],
    ["Well... it took a while.", "Who knows?!", "Nobody."],
    ["Was für eine Aussicht! 😀", "Unser Bergführer wartet.🌿", "Ende."],
    ["(See the map. It shows the way.)", "Is it true?"],
    ["那里……真的很安静。", "多美的风景！", "图申说：“在这里等。船晚点了。”然后走了。", "（请看地图。它很旧。）", "“夜里的园丁卖木头勺子。”", "你们去过吗？！ 🇯🇵", "好。"],
    ["トゥバさんは「ここで待って。船が遅れている。」と言いました。", "本当に…静かな場所でした。", "（地図を見てください。かなり古いです。）", "アプリのVer.27.18はまだ動きません。"],
    ['셴 씨는 "여기서 기다려요. 배가 늦어요."라고 말했습니다.', "글쎄요... 정말 조용한 곳이었습니다.", '"우리 안내인은 기다립니다."', "끝."],
    ["قال كيمو: «انتظر هنا. القارب متأخر.» ثم مضى.", "يسكن أ. نيبا في البيت رقم 2.", "هل صحيح؟", "نعم."],
    ["डॉ. शेपो ने 40.49 मीटर रस्सी नापी।", "क्या सुंदर दृश्य है!", "प्रो. रूरू का घर नं. 16 पर है।"],
    ["Мы видели чаек, крабов, тюленей и т. д.", "Возьмите инструменты, т. е. молоток.", "См. рис. 3 и т. 16 старой карты."],
    ['Orsor "Burada bekle. Tekne gecikti." dedi ve gitti.', "Martılar, yengeçler, foklar vb. gördük."],
]


@pytest.mark.parametrize("want", CASES)
def test_cases(want):
    cjk = any("぀" <= c <= "鿿" for c in "".join(want))
    assert parts(("" if cjk else " ").join(want)) == want


def test_thai_spaces():
    assert parts("คนสวนซ่อมโคมไฟ แอปรุ่น 3.19 ยังใช้ไม่ได้เลย คุณซาลบอกว่า“รออยู่ตรงนี้ เรือมาช้า”แล้วก็เดินไป") == ["คนสวนซ่อมโคมไฟ", "แอปรุ่น 3.19 ยังใช้ไม่ได้เลย", "คุณซาลบอกว่า“รออยู่ตรงนี้ เรือมาช้า”แล้วก็เดินไป"]


def test_lines_lists_and_missing_spaces():
    text = "# Title here\n1. First item. Second.\n2) Other\n• Third. 4. Platz\n\n#a #b"
    assert parts(text) == ["# Title here", "1. First item.", "Second.", "2) Other", "• Third.", "4. Platz", "#a #b"]
    assert parts("He left.What now?Dr. Jo came.") == ["He left.", "What now?", "Dr. Jo came."]
    assert parts("One.\r\n\r\nTwo\x0bThree three") == ["One.", "Two", "Three three"]


def test_unclosed_and_nested_pairs():
    assert parts('He said "wait here. She left. Then') == ['He said "wait here.', "She left.", "Then"]
    assert parts("A (b “c. d.” e. F) g. Next one.") == ["A (b “c. d.” e. F) g.", "Next one."]
    assert parts("don't stop. it's fine") == ["don't stop.", "it's fine"] or parts("don't stop. it's fine") == ["don't stop. it's fine"]


def test_nothing_and_very_long():
    assert [sentence_ends(t) for t in (None, "", "  \n\t　")] == [[], [], []]
    long = "A b c. " * 50_000
    assert len(sentence_ends(long)) == 50_000
    assert sentence_ends("(" * 20_000 + "." * 20_000) and sentence_ends("x" * 1_000_000) == [1_000_000]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. !?\"“”()\n1,…。「」ก😀'", max_size=60))
def test_offsets_cover_the_text(text):
    ends = sentence_ends(text)
    assert ends == sorted(set(ends))
    a = 0
    for b in ends:
        assert text[a:b].strip() and not text[b - 1].isspace()
        a = b
    assert not text[a:].strip()


def test_rows(spark):
    df = spark.createDataFrame([(1, 0, "A b. C d."), (1, 0, "A b. C d."), (2, 0, None), (3, 1, " ")], "post_id int, chunk_number int, chunk_text string").withColumn("ends", F.lit(0))
    assert sorted(tuple(r) for r in split_sentences(df, ["post_id", "chunk_number"], "chunk_text").collect()) == [(1, 0, 4), (1, 0, 9)]
    assert split_sentences(df.limit(0), ["post_id"], "chunk_text").count() == 0
