import pytest
from pyspark.sql import functions as F

from versoline.functions import text as X
from versoline.operators import texts as T
from versoline.operators import tokens as K
from versoline.sources import files as S


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text, want", [
    ("One. Two! Three? Four…", ["One.", "Two!", "Three?", "Four…"]),
    ("Mr. Smith met Dr. Jones. They left.", ["Mr. Smith met Dr. Jones.", "They left."]),
    ("K. L. Marten sailed. It rained.", ["K. L. Marten sailed.", "It rained."]),
    ("One.\u00a0Two.\u2003 Three.\u00a0", ["One.", "Two.", "Three."]),
    ("A mark\u0002inside. Next.", ["A mark\u0002inside.", "Next."]),
    ("Add 0.75 litres now. Stir.", ["Add 0.75 litres now.", "Stir."]),
    ("He stopped. and went on.", ["He stopped. and went on."]),
    ("Soup\nPeel them. Boil them.", ["Soup", "Peel them.", "Boil them."]),
    ("“Stop!” He stopped.", ["“Stop!”", "He stopped."]),
    ("(Done.) Next one", ["(Done.)", "Next one"]),
    ("  Odd   spaces.   Here  ", ["Odd   spaces.", "Here"]),
    ("Wait... what? \"Nay.\" 'Yes.' – Perhaps.", ["Wait... what?", "\"Nay.\"", "'Yes.'", "– Perhaps."]),
    ("Rekao je npr. Ivanu. Onda ode.", ["Rekao je npr. Ivanu.", "Onda ode."]),
    ("Mr.! Smith", ["Mr.! Smith"]),
    ("", []), (" \n ", []),
])
def test_sentences(spark, text, want):
    got = T.sentences(docs(spark, text)).orderBy("idx").collect()
    assert [text[r.start:r.end] for r in got] == want


def test_sentences_cover_every_visible_character(spark):
    text = "Ab. Cd ef! gh\n\nIj (kl). \t Mn… Op?"
    got = T.sentences(docs(spark, text)).orderBy("idx").collect()
    assert "".join(text[r.start:r.end] for r in got).replace(" ", "") == "".join(text.split())
    assert all(a.end <= b.start for a, b in zip(got, got[1:]))


def test_tokens_keep_their_place(spark):
    text = "Čaj, l’été -- don't 42nd ''; đak\U0001F600ß x"
    got = K.tokens(docs(spark, text)).orderBy("tok_idx").collect()
    assert [r.value for r in got] == ["caj", "lete", "dont", "42nd", "đak", "ß", "x"]
    assert [text[r.char_start:r.char_end] for r in got] == ["Čaj", "l’été", "don't", "42nd", "đak", "ß", "x"]
    assert [r.tok_idx for r in got] == list(range(7))


def test_language(spark):
    en = "the cat and the dog of that house was with his friend to which her book " * 6
    de = "der Hund und die Katze den nicht sich war mit auf ein Haus " * 6
    got = {r.doc_id: r.language for r in T.language(docs(spark, en, de, "the and of", " ".join("item%d" % i for i in range(200)))).collect()}
    assert got == {0: "en", 1: "de", 2: None, 3: None}


@pytest.mark.parametrize("value, ms", [
    ("2:10:00.25", 7800250), ("09:41.5", 581500), ("0.75s", 750), ("0.1min", 6000), ("0.25h", 900000),
    ("81ms", 81), ("13", 13000), (" 13 ", 13000), ("later", None), ("", None), ("4:3:2:1", None), ("y:1", None), ("NaN", None)])
def test_clock(spark, value, ms):
    assert one(spark, X.clock_ms, value) == ms


@pytest.mark.parametrize("name, key", [
    ("Harbour.ogg", "harbour"), ("Harbour_[Part 2].epub", "harbour part 2"), ("  Crvena  jabuka - Ana.mp3", "crvena jabuka ana"),
    ("Cafe\u0301 Noir.mp3", "café noir"), ("Pho\u031b\u0309.txt", "phở"), ("x\u0301\u0301y.txt", "x y")])
def test_names(spark, name, key):
    assert one(spark, X.name_key, name) == key


def test_stored_location(spark):
    assert one(spark, X.copy_free_key, "content://docs/document/primary%3ABooks%2FThe%20Book (2).epub") == "the book"


def test_natural_order(spark):
    names = ["a10", "A2", "a1", "a02b", "a", "b1", "a2a"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(X.natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "a1", "A2", "a2a", "a02b", "a10", "b1"]


def test_html(spark):
    html = ("<html><head><title>no</title></head><body><h1>Head&amp;ing</h1><p>One <b>bo</b>ld,\n two&nbsp;x</p><script>if (a<b) {}</script>"
            "<div>In<i>line</i><br/>next</div><!-- gone --></body></html>")
    assert one(spark, T.html_to_text, html) == "Head&ing\nOne bold, two x\nInline\nnext\n"


@pytest.mark.parametrize("html, text", [
    ("Caf&#233; &eacute;t&#xE9;", "Café été"), ("a &amp;lt; b", "a &lt; b"), ("&rsquo;&middot;&apos;", "’·'"),
    ("&#128512; & &nonsense; &#0; &#xD800; &#99999999999999999999;", "😀 & &nonsense; &#0; &#xD800; &#99999999999999999999;"), ("R&D", "R&D")])
def test_entities(spark, html, text):
    assert one(spark, T.decode_entities, html) == text


@pytest.mark.parametrize("raw, kind", [
    (b"ID3" + b"\0" * 20, "mp3"), (b"\xff\xfb" + b"\0" * 20, "mp3"), (b"OggS" + b"\0" * 20, "ogg"), (b"fLaC" + b"\0" * 20, "flac"),
    (b"\x30\x26\xb2\x75" + b"\0" * 20, "wma"), (b"\0\0\0\x20ftypM4B " + b"\0" * 9, "m4b"), (b"RIFF\0\0\0\0WAVEfmt ", "wav"),
    (b"PK\x03\x04" + b"\0" * 20, "epub"), (b"short", "txt")])
def test_sniff(spark, raw, kind):
    df = spark.createDataFrame([("/x/name.TXT", bytearray(raw))], "path string, content binary")
    assert S.format_sniff(df).first().kind == kind


def test_decode_files_from_disk(spark, tmp_path):
    text = "Prvi red\nteče dalje.\r\n\r\n  Drugi   šđčćž. \n"
    (tmp_path / "a.txt").write_bytes(text.encode("utf-8"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbf" + text.encode("utf-8"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe" + text.encode("utf-16-le"))
    (tmp_path / "d.txt").write_bytes(text.encode("cp1250"))
    got = {r.path[-5]: (r.text, r.encoding) for r in S.text_decode(S.read_files(spark, str(tmp_path))).collect()}
    want = "Prvi red teče dalje.\nDrugi šđčćž."
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys("abcd", want)
    assert [got[k][1] for k in "abcd"] == ["UTF-8", "UTF-8-BOM", "UTF-16LE", "WINDOWS-1250"]


def test_content_hash(spark):
    import hashlib
    small, big = b"hello", bytes(range(256)) * (13 * 1024)
    n, k = len(big), 1 << 20
    mid = (n - k) // 2
    want = [hashlib.sha256(len(small).to_bytes(8, "little") + small).hexdigest(),
            hashlib.sha256(n.to_bytes(8, "little") + big[:k] + big[mid:mid + k] + big[n - k:]).hexdigest()]
    df = spark.createDataFrame([(0, bytearray(small)), (1, bytearray(big))], "i int, content binary")
    got = S.content_hash(df).orderBy("i").collect()
    assert [r.hash for r in got] == want
    assert [r.digest for r in got] == [hashlib.sha256(small).hexdigest(), hashlib.sha256(big).hexdigest()]


def test_language_counts_the_whole_text(spark):
    text = " ".join(["lorem ipsum"] * 3000 + ["the and of to was"] * 100)
    r = T.language(docs(spark, text)).first()
    assert (r.words, r.hits, r.language) == (6500, 500, "en")


def test_margins_and_page_numbers(spark):
    rows = [("b", p, i, t) for p in range(8) for i, t in enumerate([f"The Book {p}", "body %d" % p, "more", str(p)])]
    df = spark.createDataFrame(rows, "book string, page int, para int, text string")
    left = T.repeated_margins(df).collect()
    assert {r.text for r in left} == {"body %d" % p for p in range(8)} | {"more"} | {str(p) for p in range(8)}
    numbers = spark.createDataFrame([("- 12 -",), ("xiv.",), ("| 3",), ("mix 3",), ("123456789",), ("",)], "t string")
    assert [r.t for r in numbers.filter(T.is_page_number(F.col("t"))).collect()] == ["- 12 -", "xiv.", "| 3"]
