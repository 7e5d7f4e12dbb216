"""Filter interaction audit, conversation structure repair and toxicity: against brute force, odd input, planted cases."""

import heapq
import random
import re
import time
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import filter_audit, structure_repair, toxicity
from shelfwise.llm.queries import QUERIES

from .support import PROSE, frame, rows, sha, varied, words

TURNS = "conv_id long, turn long, role string, text string, n_rows long, audit string, h int"


def conversations(spark, some):
    """The extra columns clash with names that the operator uses."""
    return spark.createDataFrame([(*r, 7, "x", 1) for r in some], TURNS)


# ---- structure repair ----


def plain_repair(letters):
    """Cheapest edits, least in ASCII, by Dijkstra over whole paths."""
    end, heap, done = len(letters), [(0, "", 0, "")], set()
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    missing = {"": "u", "s": "u", "u": "a", "a": "u"}
    while heap:
        cost, path, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == end and q in ("", "a"):
            return cost, path
        heapq.heappush(heap, (cost + 3, path + "I", i, missing[q]))
        if i < end:
            c, more = letters[i], 3 if letters[i].isupper() else 0
            heapq.heappush(heap, (cost + 4, path + "D", i + 1, q))
            if c != "x":
                if (q, c.lower()) in after:
                    heapq.heappush(heap, (cost + more, path + "K", i + 1, after[q, c.lower()]))
                heapq.heappush(heap, (cost + 3 + more, path + "R", i + 1, missing[q]))
    raise AssertionError


def test_search_equals_dijkstra():
    rng = random.Random(3)
    for _ in range(1500):
        letters = "".join(rng.choice("suaoSUAOxuauaua") for _ in range(rng.randrange(0, 14)))
        wanted = plain_repair(letters)
        for block in (1, 2, 5, 64):
            assert structure_repair.cheapest(letters, block) == wanted


def test_long_conversations_take_linear_time():
    rng = random.Random(4)
    letters = "".join(rng.choice("uauauauaUAsox") for _ in range(100_000))
    began = time.time()
    cost, audit = structure_repair.cheapest(letters)
    assert time.time() - began < 60
    assert sum(c != "I" for c in audit) == len(letters)
    assert structure_repair.cheapest(letters[:3000], 64) == structure_repair.cheapest(letters[:3000], 50) == plain_repair(letters[:3000])


def odd_turns():
    return [
        (1, 0, "system", "Be brief."),
        (1, 1, "user", "Hello?"),
        (1, 1, "user", "Hello?"),  # a repeated row
        (1, 4, "assistant", "Yes, and"),
        (2, None, "user", None),
        (2, 3, None, "no role."),
        (2, 2, "assistant", "fine."),
        (None, 0, "user", "of no conversation."),
        (None, None, "tool", "x" * 100_000),
        (3, 5, "", ""),
        (4, 0, "assistant", "ä ö\n!"),
        (4, 0, "user", "same turn."),
        (5, 0, "user", " ".join(f"word{i}" for i in range(50_000)) + "."),
        (5, 1, "assistant", "z."),
    ]


def plain_report(some):
    chats = {}
    for c, t, r, x in some:
        chats.setdefault(c, []).append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, turns in chats.items():
        turns.sort(key=lambda r: (*r[:3], bytes.fromhex(sha(r[3]))))
        letters, counts, seen = "", dict.fromkeys(("blank", "duplicate", "truncated"), 0), set()
        for _, _, r, x in turns:
            bare = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            one = r[:1] if r[:1] in ("s", "u", "a") else "o"
            letters += {"": one, "truncated": one.upper()}.get(fault, "x")
        cost, audit = plain_repair(letters)
        made, q, it = [], "", iter(turns)
        for e in audit:
            t = None if e == "I" else next(it)
            if e == "D":
                continue
            role = t[2] if e == "K" else "assistant" if q == "u" else "user"
            made.append(f"{role}:{t[3] if t else ''}")
            q = role[0]
        known = [t[1] for t in turns if t[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[c] = (gaps, *counts.values(), illegal, cost, audit, sha("\n".join(made)))
    return out


def test_repair_of_odd_conversations(spark):
    turns = conversations(spark, odd_turns())
    found = {r.conv_id: tuple(r)[1:] for r in structure_repair.repair_report(turns, turns).collect()}
    assert found == plain_report(odd_turns())
    made = {}
    for r in sorted(structure_repair.repair_turns(turns).collect(), key=lambda r: (str(r.conv_id), r.place)):
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    for c, said in made.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said))
        assert sha("\n".join(f"{r}:{x}" for r, x in said)) == found[c][-1]


def test_repair_of_nothing(spark):
    none = conversations(spark, [])
    assert structure_repair.repair_report(none, none).count() == 0
    ids = conversations(spark, [(9, 0, "user", "gone."), (None, 0, "user", "gone.")])
    got = {tuple(r) for r in structure_repair.repair_report(none, ids).collect()}
    assert got == {(c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in (9, None)}
    assert structure_repair.repair_turns(none).count() == 0


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(6)
    some = [(1, i // 2, rng.choice(("user", "assistant", "system")), f"said {rng.randrange(900)}{rng.choice('.,')}") for i in range(5000)]
    some += [(i, t, "ua"[t] + "xx", "fine.") for i in range(2, 300) for t in (0, 1)]
    turns = conversations(spark, some).repartition(7)
    assert {r.conv_id: tuple(r)[1:] for r in structure_repair.repair_report(turns, turns).collect()} == plain_report(some)


def test_damage(spark):
    some = [(c, t, "user" if t % 2 == 0 else None, f"one. two! {t}?") for c in range(40) for t in range(8)]
    wanted = []
    for c, t, r, x in some:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        r = " " if r is None else r
        if k:
            wanted += [(c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)] * (2 if k == 3 else 1)
    got = structure_repair.damage(conversations(spark, some)).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert {zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in some} >= {0, 1, 2, 3, 4}


# ---- filter interaction audit ----


def plain_audit(docs, labels):
    good, toxic, least = {}, {}, {}
    for i, q, t in labels:
        good[i] = good.get(i, False) or q == 1
        toxic[i] = toxic.get(i, False) or t == 1
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, s in docs:
        t, w = t or "", words(t)
        f = {c for c, bad in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t))) if bad}
        fails.append((s or "", f | ({"E"} if i is not None and i > least[t] else set()), i is not None and good.get(i, False), i is not None and toxic.get(i, False)))
    out, sums = {}, {}
    for part in {p for p, *_ in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                kept = [x for x in left if c not in x[0]]
                redundant = sum(c in x[0] for x in mine) - len(gone)
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, sum(x[0] == {c} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                sums[part, c] = sums.get((part, c), 0) + len(gone)
                left = kept
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def labelled(spark, some):
    return spark.createDataFrame(some, "doc_id long, quality int, toxic int")


def test_audit_of_odd_documents(spark):
    header = "one header of every document that goes on for more than thirty-two characters " * 30
    some = varied() + [(20 + i, header + f"ending {i % 5}", "a") for i in range(60)] + [(1, PROSE, "z"), (None, "", "a"), (90, "#" + PROSE * 3, ""), (91, "ABC " * 60, None)]
    known = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (25, None, 1), (30, 1, 1), (999, 1, 1), (5, 1, 0)]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(frame(spark, some).repartition(6), labelled(spark, known)).collect()}
    assert got == plain_audit(some, known)
    assert filter_audit.audit(frame(spark, []), labelled(spark, [])).count() == 0
    assert filter_audit.audit(frame(spark, [(3, None, None)]), labelled(spark, [])).count() == 600


def test_first_rows_under_a_hot_text(spark):
    """A third of all rows hold one text and a third one header; small tries and ranges; every task sends the text once."""
    rng = random.Random(8)
    header = "common header " * 20
    some = [(i, "hot text" if i % 3 == 0 else header + str(rng.randrange(500)) if i % 3 == 1 else str(rng.random()), "s") for i in range(6000)]
    rng.shuffle(some)
    docs = filter_audit.masked(frame(spark, some).repartition(5))
    made = sorted(r.id for r in filter_audit.first_rows(docs, flush=4000, range_chars=2000).collect())
    least = {}
    for i, t, _ in some:
        least[t] = min(least.get(t, i), i)
    assert made == sorted(least.values())
    cuts = filter_audit.adaptive_cuts(docs.select("__text"), 16)
    assert len(cuts) > 8 and cuts == sorted(set(cuts)) and any(c.startswith(header) for c in cuts)
    assert "Cartesian" not in docs._jdf.queryExecution().toString()


def test_trie():
    rng = random.Random(9)
    for _ in range(200):
        trie, least = filter_audit.Trie(), {}
        for _ in range(60):
            text, i = "".join(rng.choice("abä") for _ in range(rng.randrange(7))), rng.randrange(50)
            trie.insert(text, i, 3, "p", 1)
            least[text] = min(least.get(text, i), i)
        assert [(t, i) for t, i, *_ in trie.terminals(True)] == sorted(least.items())


def test_exact_order_of_all_filters(spark):
    got = filter_audit.audit(frame(spark, varied()), labelled(spark, [])).filter("part = 'a'")
    per = got.groupBy("filter_order").agg(F.sum("removed").alias("r"), F.min("kept").alias("k")).collect()
    assert len(per) == 120 and {(r.r, r.k) for r in per} == {(per[0].r, per[0].k)}


# ---- toxicity ----


@pytest.fixture(scope="module")
def decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = docs.select("text").unionByName(spark.createDataFrame([("you stupid idiot and pathetic loser, what disgusting worthless trash, a moron",)] * 40, "text string"))
    return toxicity.Decoder(toxicity.trigram_model(toxicity.count_trigrams(said)))


@pytest.mark.parametrize(
    "said, meant",
    [
        ("an 1d10t!", "an idiot!"),
        ("m0r0n", "moron"),
        ("w0rthle55", "worthless"),
        ("you $tupid", "you stupid"),
        ("i d i o t", "idiot"),
        ("such a l-o-s-e-r", "such a loser"),
        ("stuuupid", "stupid"),
        ("i.d.i.o.t", "idiot"),
        ("id-iot", "idiot"),
        ("p a t h e t i c  t r a s h", "pathetic trash"),
        ("L0S3R", "loser"),
        ("stu​pid", "stupid"),
        ("stupіd", "stupid"),
        ("all is well, the 15 of 2024.", "all is well, the 15 of 2024."),
        ("4668799872880523", "4668799872880523"),
    ],
)
def test_decoder(decoder, said, meant):
    assert decoder.restore(said) == meant


def test_viterbi_equals_all_readings(decoder):
    """The best of all paths through the lattice, one by one."""
    from itertools import product

    def worth(parts):
        s, total = toxicity._BLANK * 65, 0.0
        for out, cost in parts:
            total += cost
            for c in out:
                k = s * 64 + int(toxicity._TABLE[ord(c)])
                total += decoder.model[k]
                s = k % 4096
        return total + decoder.model[s * 64 + toxicity._BLANK]

    rng = random.Random(2)
    for spaced in (False, True):
        for _ in range(60):
            word = "".join(rng.choice("idot013!$*. -aab") for _ in range(rng.randrange(1, 7)))
            paths = list(product(*decoder._readings(word, spaced)))
            best = max(paths, key=worth)
            got = decoder._decode(word, spaced)
            assert any("".join(x for x, _ in p) == got and abs(worth(p) - worth(best)) < 1e-9 for p in paths)


def test_trigram_counts_cover_all_rows(spark):
    some = frame(spark, varied())
    counts = toxicity.count_trigrams(some)
    wanted = np.zeros(64**3, np.int64)
    for _, t, _ in varied():
        s = [26, 26, *(int(toxicity._TABLE[min(ord(c), 0x3001)]) for c in (t or "").lower()), 26, 26]
        for a, b, c in zip(s, s[1:], s[2:]):
            wanted[(a * 64 + b) * 64 + c] += 1
    inside = np.arange(64**3) // 64 % 64 != 26  # blanks between texts depend on the batches
    assert np.array_equal(counts[inside], wanted[inside])


def test_toxicity_of_odd_documents(spark):
    labels = labelled(spark, [(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, 1, None), (777, 0, 1)])
    made = toxicity.toxicity_scores(frame(spark, varied()), labels).collect()
    assert sorted(str(r.doc_id) for r in made) == sorted(str(i) for i, _, _ in varied())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in made)
    assert toxicity.toxicity_scores(frame(spark, []), labels).count() == 0
    alone = toxicity.toxicity_scores(frame(spark, [(3, None, None)]), labelled(spark, [])).collect()
    assert [(r.doc_id, r.score, r.predicted) for r in alone] == [(3, 0.1, 0)]


def test_toxicity_on_held_out_and_disguised_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op13_toxicity"](spark, sf).collect()}
    con = duckdb.connect()
    known = con.execute(f"SELECT doc_id, toxic, text FROM '{sf}/labels.parquet' JOIN '{sf}/documents.parquet' USING (doc_id)").fetchall()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, t) for i, t, _ in known if got[i].held_out]
    assert np.mean([p for p, t in held if t == 1]) > 0.85 and np.mean([p for p, t in held if t == 0]) < 0.02
    # The same model on held-out clean texts into which a disguised insult is put.
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    clean = [(i, t) for i, toxic, t in known if got[i].held_out and toxic == 0 and got[i].predicted == 0 and len(t) > 200][:120]
    hidden = ["1d10t", "m0r0n", "p a t h e t i c", "stuuupid", "w0rthle55", "l-o-s-e-r"]
    texts = [(10**6 + i, ' '.join([*t.split(' ')[:9], hidden[n % 6], *t.split(' ')[9:]])) for n, (i, t) in enumerate(clean)]
    put = spark.createDataFrame(texts, "doc_id long, text string")
    scored = {r.doc_id: r for r in toxicity.toxicity_scores(docs.select("doc_id", "text").unionByName(put), labels).collect()}
    assert np.mean([scored[i].predicted for i, _ in texts]) > 0.9
    assert rows(put.limit(1))
