from pyspark.sql import functions as F

from versoline.sources import overlay as O


SMIL = """<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body><seq>
<par id="p1"><text src="../text/ch1.xhtml#a"/><audio src="../audio/x.mp3" clipBegin="0:00:01.500" clipEnd="3s"/></par>
<par id="p2"><text src="../text/ch1.xhtml#b"/><audio src="../audio/x.mp3" clipBegin="3s" clipEnd="5s"/></par>
<par id="p3"><text src="../text/ch1.xhtml"/><audio src="../audio/x.mp3" clipBegin="whenever"/></par>
</seq></body></smil>"""


def test_overlay_files_to_anchors(spark, tmp_path):
    folder = tmp_path / "OEBPS" / "smil"
    folder.mkdir(parents=True)
    (folder / "c.smil").write_text(SMIL)
    pars = O.read_pars(spark, str(folder)).withColumn("smil", F.regexp_extract("smil", "(OEBPS/.*)$", 1)).withColumn("book_id", F.lit(1))
    ids = spark.createDataFrame([(1, "OEBPS/text/ch1.xhtml", "a", 0), (1, "OEBPS/text/ch1.xhtml", "b", 40), (1, "OEBPS/text/ch1.xhtml", None, 0)],
                                "book_id int, entry string, fragment string, char_offset int")
    got = sorted((r.audio, r.audio_ms, r.char_offset) for r in O.anchors(pars, ids).collect())
    assert got == [("OEBPS/audio/x.mp3", 1500, 0), ("OEBPS/audio/x.mp3", 3000, 40)]


def test_offsets_move_to_visible_text(spark):
    offsets = spark.createDataFrame([(1, 0), (1, 3), (1, 5)], "book_id int, char_offset int")
    texts = spark.createDataFrame([(1, " \nab cd")], "book_id int, text string")
    assert sorted(r.char_offset for r in O.on_visible(offsets, texts).collect()) == [2, 3, 5]
