import public_tokenizers
import regex

from vigilark.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def by_matches(library, text):
    return [x for m in regex.finditer(PATTERN, text) for x in library._encode_single_piece(m[0])]


def test_ids_are_those_of_each_match():
    encoder = byte_bpe.Encoder(PATH, PATTERN)
    for text in ("", "a  b", "x" * 5000, " " * 3000, "a" + " " * 3000 + "b", "a\n" + "\n" * 2500 + "x y" + "\t" * 1200,
                 "word " * 30000, "é'll  don't\n\n 12ab!!" * 9000, "　" * 1500 + "z", "日本 語。" * 20000):
        ids = encoder.ids(text)
        assert ids == by_matches(encoder.library, text)
        assert encoder.library.decode_bytes(ids) == text.encode()


def test_round_trip_keeps_rows_and_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "Hello  wörld\x00", "c"), (2, "Hello", "d"), (2, "Hello", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = byte_bpe.encode(docs, PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    got = byte_bpe.decode(coded, PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), r.text, bytes(r["bytes"]).decode()) for r in got if r.text is not None) == sorted(
        (str(a), b, b) for a, b, _ in rows if b is not None)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    empty = byte_bpe.encode(docs.limit(0), PATH, PATTERN)
    assert byte_bpe.decode(empty, PATH, PATTERN).collect() == []


def test_ids_are_decoded_in_the_worker_that_made_them(spark):
    docs = spark.createDataFrame([(1, None), (2, "Hello  wörld\x00"), (3, "é" * 9000), (None, "x")], "doc_id long, text string")
    at_once = byte_bpe.encode(docs, PATH, PATTERN, decoded=True, keep_text=False)
    assert at_once.columns == ["doc_id", "n_tokens", "ids", "bytes"]
    apart = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).select(*at_once.columns)
    assert sorted(map(str, at_once.collect())) == sorted(map(str, apart.collect()))
    plan = at_once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
