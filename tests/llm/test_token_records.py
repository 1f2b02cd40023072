import zlib

import numpy as np
import pytest

from strandwise.llm import token_records as tr
from strandwise.llm.crc32c import crc32c, masked

TEXTS = [
    "Hello, World! It's the reader's 3rd test; naïve café.", "", "  spaces\n\nand\ttabs here  ", "ÀÉÎ straße İstanbul ΣΑΣ",
    "étude ́alone", "x" * 500, "<|endoftext|> in text", "don't we'll I'd", "日本語 テキスト", "a.b, c.. d!? e,", "¡señor! ñandú,", "ſtrange ﬁ ǅ ǆ",
]


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tr.default_vocabulary())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_whole_texts():
    got = tr.Encoder(tr.default_vocabulary())(TEXTS)
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [ids + [tr.END] for ids in whole(TEXTS)]


def test_encoder_on_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = tr.Encoder(tr.default_vocabulary())(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [ids + [tr.END] for ids in whole(texts)]


def test_crc32c_known_values():
    parts = [b"123456789", b"", b"a", b"\x00" * 32, b"\xff" * 32, bytes(range(256)) * 5, b"abc"]
    got = crc32c(parts)
    assert got[0] == 0xE3069283 and got[1] == 0 and got[3] == 0x8A9136AA and got[4] == 0x62A8AB43 and got[6] == 0x364B3FB7
    c = 0xFFFFFFFF
    for b in parts[5]:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    assert got[5] == c ^ 0xFFFFFFFF
    assert masked(got).dtype == np.uint32


def test_round_trip(spark, tmp_path):
    rows = [(9, "b c"), (2, None), (2, "two words"), (2, "two words"), (None, "no id"), (-4, ""), (7, "long " * 3000)]
    docs = spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id long, text string, key string, start int")
    got = tr.read_records(tr.write_records(docs, str(tmp_path))).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [i + [tr.END] for i in whole([t or "" for _, t in order])]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])[:-1].tolist()
    crc = [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
    want = [(None if k is None else str(k), s, len(i), c) for (k, _), s, i, c in zip(order, starts, ids, crc)]
    assert [tuple(r) for r in got] == want


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tr.read_records(tr.write_records(docs, str(tmp_path))).count() == 0


def test_frames_in_any_order_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    path = tr.write_records(docs, str(tmp_path)).first().path
    shard = tr.Shard(path, 2)
    assert shard.read(0, 1)[0][0] is not None and len(shard.read(0, len(shard.index))) == len(shard.index)
    with open(path + ".bin", "r+b") as f:
        f.seek(20)
        f.write(b"\x99")
    with pytest.raises(OSError):
        tr.Shard(path, 2).read(0, 1)


def test_words_are_kept_once():
    encode = tr.Encoder(tr.default_vocabulary())
    got = encode(["word Word word,"])
    assert np.frombuffer(got[0], "<u2").tolist() == whole(["word Word word,"])[0] + [tr.END]
    assert sum(len(v) for v in vars(encode).values() if isinstance(v, dict)) == 4  # three pieces and a mark


def test_reading_lets_go_of_the_encoder():
    tr.encoder(tr.default_vocabulary())
    assert list(tr._decoder(2)(iter([]))) == [] and tr.encoder.cache_info().currsize == 0
