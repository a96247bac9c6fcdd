from __future__ import annotations

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from marquee.llm import pieces
from marquee.llm.queries import op6_sentencepiece
from tests.llm.util import SF, documents

TEXTS = ["", " ", "Hello world", "  two  spaces ", "a\n\tb", "Ünïcødé ß", "日本語のテキスト", "😀 emoji 😀😀", "☃x", "x" * 5000, "the " * 3000, "mixed space", "\x00\x01", "ab͸cd"]


@pytest.fixture(scope="module")
def encoder():
    return pieces.load_encoder()


def brute(encoder, table, text):
    """Viterbi over the whole text, character by character."""
    if not text:
        return [], 0.0
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    best = [(0.0, None, None)] + [(-np.inf, None, None)] * len(s)
    for i in range(len(s)):
        one = False
        for j in range(i + 1, min(len(s), i + 48) + 1):
            k = table.get(s[i:j])
            if k is not None:
                one |= j == i + 1
                score = best[i][0] + encoder.scores[k]
                if score > best[j][0]:
                    best[j] = (score, i, k)
        if not one:
            score = best[i][0] + encoder.unknown_score
            if score > best[i + 1][0]:
                best[i + 1] = (score, i, encoder.unknown)
    out, j = [], len(s)
    while j:
        _, i, k = best[j]
        out.append(encoder.byte_ids[list(s[i:j].encode())].tolist() if k == encoder.unknown else [k])
        j = i
    return [x for part in out[::-1] for x in part], best[-1][0]


def test_like_brute_force(encoder, spark):
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        model = pieces.read_model(f.read())
    table = {p: i for i, (p, _, k) in enumerate(model) if k in (pieces.NORMAL, pieces.USER)}
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    texts = TEXTS + [r.text for r in rows if len(r.text) < 3000]
    ids, edges, scores = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        own = ids[edges[i] : edges[i + 1]].tolist()
        want, score = brute(encoder, table, t)
        assert own == want, t[:50]
        assert scores[i] == pytest.approx(score, rel=1e-12)
        assert encoder.decode(own) == t.encode()


def test_like_the_library(encoder):
    """The public library on the same pieces, told that they are a unigram model."""
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        data = f.read()
    # Keep every field but the trainer's model type (field 3 of message 2), which becomes 1.
    out = b""
    score = iter(pieces.log_scores(pieces.read_model(data)))
    for number, value in pieces._fields(data):
        body = b""
        if number == 1:  # the piece with its log score
            text, logp, kind = next(score)
            raw = text.encode()
            value = b"\x0a" + bytes([len(raw)]) + raw + b"\x15" + struct.pack("<f", logp) + b"\x18" + bytes([kind])
        if number == 2:
            at = 0
            while at < len(value):
                start = at
                tag, at = pieces._varint(value, at)
                if tag & 7 == 0:
                    _, at = pieces._varint(value, at)
                elif tag & 7 == 2:
                    n, at = pieces._varint(value, at)
                    at += n
                else:
                    at += 4 if tag & 7 == 5 else 8
                body += b"\x18\x01" if tag >> 3 == 3 else value[start:at]
            value = body
        n, size = len(value), b""
        while n > 127:
            size, n = size + bytes([n & 127 | 128]), n >> 7
        out += bytes([number << 3 | 2]) + size + bytes([n]) + value
    library = sentencepiece.SentencePieceProcessor(model_proto=out)
    rng = random.Random(9)
    words = ["the", "running", "Straße", "été", "x1y2", "internationalisation", "日本", "ñandú", "zzzqqq"]
    texts = ["Hello world", "Ünïcødé ß", *(" ".join(rng.choices(words, k=20)) for _ in range(30))]
    ids, edges, _ = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        # The library sums in single precision, in which long sums of these scores tie or round.
        own, other = ids[edges[i] : edges[i + 1]].tolist(), library.encode(t)
        assert own == other or encoder.scores[own].sum() >= encoder.scores[other].sum(), t
        assert library.decode(library.encode(t)) == encoder.decode(ids[edges[i] : edges[i + 1]]).decode()


def test_small_model_with_ties_and_inner_markers():
    model = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    model += [(p, s, 1) for p, s in (("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("a▁b", -2.5), ("aab", -3.0), ("▁a", -3.0))]
    encoder = pieces.Encoder.of(model)
    assert not encoder.splits
    table = {p: i for i, (p, _, k) in enumerate(model) if k == 1}
    rng = random.Random(10)
    texts = ["".join(rng.choices("ab cé", k=rng.randrange(40))) for _ in range(200)]
    ids, edges, _ = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == brute(encoder, table, t)[0]
        assert encoder.decode(ids[edges[i] : edges[i + 1]]) == t.encode()


def test_trie_finds_exactly_its_keys():
    rng = random.Random(11)
    keys = sorted({bytes(rng.choices(range(256), k=rng.randrange(1, 6))) for _ in range(3000)})
    base, check, value = pieces.build_trie(keys)

    def find(key):
        node = 0
        for b in key:
            to = base[node] + b
            if to == 0 or check[to] != node:
                return -1
            node = to
        return value[node]

    assert [find(k) for k in keys] == list(range(len(keys)))
    known = set(keys)
    assert all(find(k) == -1 for k in (bytes(rng.choices(range(256), k=4)) for _ in range(3000)) if k not in known)


def test_rows(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "x"), (2, "Hello world"), (101, "a ▁ b")])
    got = pieces.encode(docs).collect()
    assert len(got) == len(TEXTS) + 4
    assert all(r.round_trip for r in got if r.doc_id != 101) and not [r for r in got if r.doc_id == 101][0].round_trip
    assert all(len(r.ids) == r.n_pieces >= r.n_bytes for r in got)
    assert [r.ids for r in got if r.doc_id == 100] == [[]]
    assert pieces.encode(docs.limit(0)).count() == 0


def test_table(spark):
    rows = op6_sentencepiece(spark, SF).collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)


def test_scores_are_log_probabilities(encoder):
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        data = f.read()
    model = pieces.read_model(data)
    assert pieces.model_type(data) == 2
    own = [i for i, (_, _, k) in enumerate(model) if k in (pieces.NORMAL, pieces.USER)]
    assert abs(np.exp(encoder.scores[own]).sum() - 1) < 1e-5
    first, last = max(own, key=lambda i: model[i][1]), min(own, key=lambda i: model[i][1])
    assert encoder.scores[first] == max(encoder.scores[own]) and encoder.scores[last] == min(encoder.scores[own])


def test_decode_rows(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (50, None)])
    got = pieces.decode(pieces.encode(docs, keep=("doc_id",)).selectExpr("doc_id", "ids", "'clash' AS decoded")).collect()
    assert sorted((r.decoded for r in got)) == sorted(TEXTS + ["x y", ""])
    odd = spark.createDataFrame([(1, None), (2, [10**6]), (3, [3 + 0xC3]), (4, [])], "doc_id int, ids array<int>")
    assert [(r.doc_id, r.decoded) for r in pieces.decode(odd).orderBy("doc_id").collect()] == [(1, None), (2, None), (3, None), (4, "")]
    assert pieces.decode(odd.limit(0)).count() == 0
