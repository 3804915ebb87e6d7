"""Token files: the coder's round trip, ids as the library gives them, torn and changed files, the query against brute force."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from quire.llm import range_coder, token_files
from quire.llm.queries import op11_token_files

MODEL = public_tokenizers.path("word_bpe_49k.json")
ATOMS = "a|bc|Été|é|́|'s|'t|'|’|'re|,|…| |\n|\t| | |\x1c|1|23|ß|İ|I|Σ|ſ|Word|word|-|​|😀|中文|<|_|\x00|ŉ|ﬁ|µ|×|ª|K|`|`|;|;|﻿|ǆ|ͅ|न|ि|²|\x85|don't|'LL|Ⅳ".split("|")


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(MODEL).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 70_000])
@pytest.mark.parametrize("vocabulary", [1, 3, 49_408, range_coder.MAX_IDS])
def test_block_round_trip(n, vocabulary):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, vocabulary, n), np.minimum(rng.zipf(1.3, n) - 1, vocabulary - 1), np.full(n, vocabulary - 1)):
        assert (range_coder.decode(range_coder.encode(ids, vocabulary)) == ids).all()


def test_wide_blocks_come_back_whole():
    ids = np.minimum(np.random.default_rng(6).zipf(1.3, 4096 * 257 + 77), range_coder.MAX_IDS) - 1
    block = range_coder.encode(ids, range_coder.MAX_IDS)
    assert range_coder.HEAD.unpack_from(block)[3] == 4096  # lanes, some of which have an id more
    assert (range_coder.decode(block) == ids).all() and token_files.BLOCK // range_coder.LANES == 512


def test_prediction_pays():
    ids = np.tile(np.random.default_rng(1).integers(0, 49_408, 1000), 60)
    assert len(range_coder.encode(ids, 49_408)) < len(ids) / 2


def test_ids_beyond_the_vocabulary_are_an_error():
    for ids in ([5], [-1]):
        with pytest.raises(ValueError):
            range_coder.encode(np.array(ids), 5)


def test_every_changed_byte_is_noticed():
    block = range_coder.encode(np.arange(700) % 50, 60)
    for at in range(0, len(block), 7):
        with pytest.raises(ValueError):
            range_coder.decode(block[:at] + bytes([block[at] ^ 16]) + block[at + 1 :])
    with pytest.raises(ValueError):
        range_coder.decode(block[:-1])


def test_encoder_equals_the_library():
    rng = random.Random(3)
    marks = [*ATOMS, "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in token_files.Encoder(MODEL)(texts)]
    assert got == library_ids(texts)


def documents(spark, folder):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice([*ATOMS, " "]) for _ in range(rng.randint(0, 60)))) for k in rng.sample(range(10_000), 300)]
    rows += [(50_000, "the same words " * 9000), (50_001, None), (50_002, ""), (None, "no id"), (-3, "first")] + [(7777, "twin")] * 40
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5).write.parquet(f"{folder}/documents.parquet")
    return rows


def expected(rows):
    out, start = [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (doc_id, _), ids in zip(rows, library_ids([t or "" for _, t in rows])):
        ids = [*ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rows = documents(spark, tmp_path)
    got = op11_token_files(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected(rows)


def test_documents_go_on_from_block_to_block(spark, tmp_path):
    rows = documents(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    manifest = token_files.write_token_files(docs, MODEL, folder=f"{tmp_path}/tokens", block=1000, files=4)
    files = [r.file for r in manifest.collect()]
    assert len(files) > 1 and sorted(os.listdir(f"{tmp_path}/tokens")) == sorted(f.rpartition("/")[2] for f in files)
    assert sorted((tuple(r) for r in token_files.documents_of(manifest).collect()), key=lambda r: r[1]) == expected(rows)
    pieces = {}
    for r in token_files.read_token_files(manifest).orderBy("start").collect():
        pieces.setdefault((r.doc_id, r.start if r.piece == 0 else None), []).extend(r.ids) if r.piece == 0 else pieces[next(reversed(pieces))].extend(r.ids)
    assert [len(x) for x in pieces.values()] == [r[2] for r in expected(rows)]
    again = token_files.write_token_files(docs, MODEL, folder=f"{tmp_path}/tokens", block=1000, files=4)  # files are replaced
    assert sorted((tuple(r) for r in token_files.documents_of(again).collect()), key=lambda r: r[1]) == expected(rows)


def test_torn_files_are_errors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string").coalesce(1)
    name = token_files.write_token_files(docs, MODEL, folder=f"{tmp_path}/t").first().file
    whole = open(name, "rb").read()
    assert [p for p, _ in token_files.blocks(name)] and whole[:4] == b"QTF1"
    for cut in (3, 20, len(whole) - 1, len(whole) - 21):
        with open(name, "wb") as out:
            out.write(whole[:cut])
        with pytest.raises(ValueError):
            list(token_files.blocks(name))


def test_empty(spark):
    assert token_files.documents_of(token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), MODEL)).collect() == []


def test_new_words_are_encoded_together_and_cut_where_they_end():
    rng = random.Random(5)
    words = list(dict.fromkeys("".join(rng.choices("abcdeéÉßñĳŉſ", k=rng.randint(1, 9))) for _ in range(5000)))
    odd = ["a×b", "c÷d", "İx", "µm", "x1", "'s"]
    encoder = token_files.Encoder(MODEL)
    assert encoder._learn([w.encode() for w in words[:2000] + odd + words[2000:]]) == [w.encode() for w in odd]
    assert [np.frombuffer(encoder.known[w.encode()], "<u4").tolist() for w in words] == library_ids(words)


def test_units_of_order_0_are_found():
    for vocabulary in (1, 300, range_coder.MAX_IDS):
        model = range_coder._Model(vocabulary, 5000)
        units = np.random.default_rng(7).integers(0, 1 << range_coder.UNITS, 4096).astype(np.uint64)
        got = model.of_units(units)
        assert (model.starts[got] <= units).all() and (units < model.starts[got + 1]).all()


def test_a_word_is_learned_once_in_any_case():
    encoder = token_files.Encoder(MODEL)
    texts = ["The the THE tHE", "É é (Été) été"]
    assert [ids.tolist() for ids in encoder(texts)] == library_ids(texts) and len(encoder.known) == 5  # with two brackets
    odd = ["H\u0331 A\u030a K\u030c", "don't DON'T", "Ⅳ'THE ÀΣ ΣÀ"]
    assert [ids.tolist() for ids in encoder(odd)] == library_ids(odd)


def test_every_plain_letter_is_encoded_as_by_the_library():
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x180))]
    rng = random.Random(8)
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 3))) + letter + "".join(rng.choices("abcABCéÉ", k=rng.randint(0, 3))) for letter in letters for _ in range(20)]
    texts += [" ".join(texts), *letters, *(f"{a}{b}" for a in letters for b in "\u0301\u0331'<.")]
    encoder = token_files.Encoder(MODEL)
    assert encoder.library not in encoder.of_words and [ids.tolist() for ids in encoder(texts)] == library_ids(texts)
    encoder.of_words = [encoder.library] * 2  # of a tokenizer with other steps
    encoder.known = token_files._Known()
    assert [ids.tolist() for ids in encoder(texts)] == library_ids(texts)


def test_counts_are_brought_up_to_date_in_growing_intervals(monkeypatch):
    times = []
    refresh = range_coder._Model._refresh
    monkeypatch.setattr(range_coder._Model, "_refresh", lambda model: (times.append(1), refresh(model)))
    ids = np.minimum(np.random.default_rng(9).zipf(1.3, 512 * 40), 50) - 1
    block = range_coder.encode(ids, 50)
    assert range_coder.HEAD.unpack_from(block)[3] == 80 and len(times) == 14  # lanes of 256 steps: at the start, five times after eight steps, then less often
    assert (range_coder.decode(block) == ids).all() and len(times) == 28


def test_carries_run_through_words_of_ones():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        ids = np.where(rng.random(3000) < 0.9, 49_407, rng.integers(0, 49_408, 3000))
        assert (range_coder.decode(range_coder.encode(ids, 49_408)) == ids).all()
