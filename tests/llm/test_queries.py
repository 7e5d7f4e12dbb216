"""Registered queries against DuckDB SQL or brute force on the small tables."""

import random

import duckdb
import numpy as np
import pytest

from shelfwise.llm import bpe, secret_scan
from shelfwise.llm.queries import ORACLE_SQL, QUERIES, vocabulary_path
from tools.parity import rows as comparable

from .support import sha, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    made = QUERIES[name](spark, SF).toPandas()
    wanted = tables.execute(ORACLE_SQL[name]).df()
    assert comparable(made) == comparable(wanted)
    assert len(made) > 10


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op1_fingerprints"](spark, SF).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got, reverse=True) == order
    by_text = {}
    for a, b in zip(order, order[1:] + order[:1]):
        n = len(texts[a]) // 3
        edited = texts[a][: len(texts[a]) - n] + texts[b][:n]
        assert got[a].n_chars == len(texts[a]) and got[a].edited_sha256 == sha(edited)
        for x, y, near in ((texts[a], edited, got[a].near_edited), (texts[a], texts[b], got[a].near_next)):
            left, right = shingles(x, 5), shingles(y, 5)
            true = len(left & right) / len(left | right) if left | right else 1.0
            assert abs(near - true) < 0.25
        assert by_text.setdefault(texts[a], got[a].fingerprint) == got[a].fingerprint


def test_bpe_equals_library(spark, texts):
    whole = bpe.Vocabulary.load(vocabulary_path()).whole
    for r in QUERIES["op9_bpe"](spark, SF).collect():
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(" ".join(map(str, ids)))
        assert r.decoded_sha256 == sha(whole.decode(ids, skip_special_tokens=False))


def test_secret_spans(spark, texts):
    """Base spans by a second reading of the rules; added spans lie outside them."""
    import re

    patterns = {
        "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"(?P<v>AKIA[A-Z0-9]+)"),
        "hex": re.compile(r"(?P<v>[0-9a-f]+)"),
    }
    least = {"assign": 8, "access": 16, "hex": 32}
    for r in QUERIES["op8_secret_scan"](spark, SF).collect():
        spans = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(patterns.items()) for m in p.finditer(texts[r.doc_id]) if len(m["v"]) >= least[k]]
        spans = [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]
        assert r.base_sha256 == sha(",".join(spans))
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == spans
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in patterns)


def test_markov_ratio_tells_random_from_ordinary(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(200)]
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(31)) for _ in range(200)]
    words = [w.lower() for t in list(texts.values())[100:] for w in t.split() if w.isascii() and w.isalpha()]
    plain = ["_".join(rng.sample(words, 4)) for _ in range(200)]
    hit = lambda xs: np.mean([secret_scan.ratio(model, x) >= secret_scan.MIN_RATIO for x in xs])
    assert hit(made) > 0.95 and hit(hexes) > 0.95 and hit(plain) < 0.05
    long_plain = [x for x in plain if len(x) >= secret_scan.MIN_RUN][:20]
    text = f"see {made[0]} and {long_plain[0]} end"
    assert [k for k, _, _ in secret_scan.scan_text(text, model)[1]] == ["markov"]


def test_classifier_on_held_out_rows(spark, tables):
    got = {r.doc_id: r for r in QUERIES["op7_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    con = duckdb.connect()
    labels = dict(con.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    import zlib

    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
