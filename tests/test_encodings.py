"""Encodings that bytes don't declare, and the exactly-once sink of token streams."""

import json
from pathlib import Path

import pytest

from textloom.operators import bpe
from textloom.sources import encodings, wet
from textloom.streaming import token_sink

FRENCH = "Après l'été, le château est fermé ; les élèves sont allés à l'école où ils étudient l'œuvre de l'évêque. Ça va très bien, n'est-ce pas ? Noël à Genève."
GERMAN = "Die Straße war über Nacht schön weiß geworden, und die Bäume trugen große Äste. Für die Kinder gab es Brötchen und Käse; später kamen Gäste."
SPANISH = "El niño comió mañana una piña pequeña. ¿Cómo está la señora Muñoz? Según él, la canción más bonita se escuchó en Málaga ayer."
RUSSIAN = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме Облонских. Жена узнала, что муж был в связи."
JAPANESE = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。"
CHINESE = "我们今天去北京的时候,天气很好。老师说学生应该每天看书,写字,也要锻炼身体。中国的经济发展得很快,人民的生活越来越好。"
TRADITIONAL = "我們今天去臺北的時候,天氣很好。老師說學生應該每天看書,寫字,也要鍛鍊身體。經濟發展得很快,人民的生活越來越好。"
KOREAN = "우리는 오늘 학교에 갔다가 친구를 만났습니다. 날씨가 아주 좋아서 공원에서 점심을 먹고 이야기를 많이 했습니다."
POLISH = "Zażółć gęślą jaźń. Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."


@pytest.mark.parametrize(
    ("text", "encoding"),
    [(FRENCH, "cp1252"), (GERMAN, "latin-1"), (SPANISH, "latin-1"), (RUSSIAN, "cp1251"), (RUSSIAN, "koi8-r"), (JAPANESE, "shift_jis"), (JAPANESE, "euc-jp"), (CHINESE, "gbk"), (TRADITIONAL, "big5"), (KOREAN, "euc-kr"), (POLISH, "cp1250")]
    + [(t, e) for t in (FRENCH, GERMAN, RUSSIAN, JAPANESE, CHINESE, "plain words of no accent") for e in ("utf-16-le", "utf-16-be", "utf-16", "utf-8", "utf-8-sig")],
)
@pytest.mark.parametrize("page", [False, True])
def test_undeclared_encodings(text, encoding, page):
    """Bare texts and pages with much markup around them, none of which declares anything."""
    text = f"<html><head><title>page</title></head><body><div class='main'><p>{text}</p></div></body></html>" if page else text
    assert wet.decode_html(text.encode(encoding)).removeprefix("﻿") == text


def test_declared_and_broken():
    assert wet.decode_html(b"<meta charset=koi8-r>" + RUSSIAN.encode("koi8-r")).endswith(RUSSIAN)
    assert wet.decode_html(b"<meta charset=nosuch>\xff") == "<meta charset=nosuch>�"
    assert wet.decode_html(b"") == wet.decode_html(None) == ""
    long = (RUSSIAN * 900).encode("cp1251")
    assert encodings.detect(long) == "cp1251" and encodings.detect(("é" * 50_000).encode()) == "utf-8" and encodings.detect(("字x" * 50_000).encode()) == "utf-8"
    assert encodings.detect(b"\xff") in encodings.CANDIDATES


def test_decoded_column(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, t.encode(e)) for k, (t, e) in enumerate([(RUSSIAN, "cp1251"), (JAPANESE, "shift_jis"), (FRENCH, "utf-8")])], "k int, data binary")
    assert [r[0] for r in rows.orderBy("k").select(wet.decoded_html(F.col("data"))).collect()] == [RUSSIAN, JAPANESE, FRENCH]


def token_stream(spark, folder, tokenizer):
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    return bpe.encode(stream, tokenizer)


def test_tokens_of_a_stream_once(spark, tmp_path):
    """A query that ends in the middle, one whose last note of a commit is lost, and one that failed before it: every document's ids once."""
    tokenizer = bpe.Tokenizer({i: bytes([i]) for i in range(256)} | {256: b"th"}, [(b"t", b"h")])
    texts = [f"the {k} thin" for k in range(30)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    source, out, notes = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "notes")

    def run():
        query = token_sink.write_stream(token_stream(spark, source, tokenizer), out, notes)
        query.awaitTermination()

    def found():
        ids = sorted(tuple(r["ids"]) for r in token_sink.read(spark, out).collect())
        counts = token_sink.parts(spark, out).agg({"docs": "sum", "tokens": "sum"}).first()
        return ids, (counts["sum(docs)"], counts["sum(tokens)"])

    rows.where("doc_id < 10").coalesce(1).write.mode("append").parquet(source)
    run()
    first = found()
    rows.where("doc_id between 10 and 19").coalesce(1).write.mode("append").parquet(source)
    run()
    second = found()
    last = max(int(p.name) for p in Path(notes, "commits").glob("[0-9]*"))
    for p in Path(notes, "commits").glob(f"*{last}*"):  # as if the driver had died before noting the commit
        p.unlink()
    run()
    assert found() == second and first != second
    Path(out, "part-stray.bin").write_bytes(b"\1\0\0\0")
    manifest = Path(out, f"batch-{last:012d}.json")
    named = json.loads(manifest.read_text())
    manifest.unlink()  # as if it had died before the commit: the files are there and don't count
    for p in Path(notes, "commits").glob(f"*{last}*"):
        p.unlink()
    run()
    assert found()[1] == second[1] and found()[0] == second[0] and json.loads(manifest.read_text())["parts"] != named["parts"]
    rows.where("doc_id >= 20").coalesce(1).write.mode("append").parquet(source)
    run()
    want = [tokenizer.encode(t or "") for t in texts]
    ids, (docs, tokens) = found()
    assert docs == 31 and tokens == sum(map(len, want)) and sorted(i for x in ids for i in x) == sorted(i for x in want for i in x)
    with pytest.raises(Exception, match="fit"):
        token_sink.write_stream(token_stream(spark, source, tokenizer), str(tmp_path / "small"), str(tmp_path / "n2"), dtype="<u1").awaitTermination()
