import itertools
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[1]))

from hearthgauge.llm import conversation_repair, packing, queries, spelling_variants

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n int, `key` string, id long, root string"
TURNS = "conv_id long, turn long, role string, text string, audit string, cost int"


# ---- spelling variants


def words_of(rows, least=7, times=2):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= times}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in near.items()}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def variants(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def spoiled(rng):
    base = ["".join(rng.choice("abcéÿ") for _ in range(rng.randrange(7, 12))) for _ in range(6)]
    said = []
    for w in base:
        for _ in range(rng.randrange(1, 120)):
            v = w
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                i, c = rng.randrange(len(v)), rng.choice("abcéÿ")
                v = rng.choice([v[:i] + v[i + 1 :], v[:i] + c + v[i:], v[:i] + c + v[i + 1 :]])
            said.append(rng.choice([v, v, v.upper() if v.isascii() else v]))
    rng.shuffle(said)
    return said


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    said = spoiled(rng)
    rows = [(i, rng.choice([" ", ", ", "×", "1"]).join(said[k : k + 40])) for i, k in enumerate(range(0, len(said), 40))]
    assert variants(spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == variants_of(words_of(rows))


def test_variants_of_odd_documents(spark):
    long = "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))
    rows = [(1, "colours colours Colours"), (1, "colours colours Colours"), (2, None), (3, ""), (None, "Colours " * 30 + "colour colour"), (4, "y" * 30_000 + " " + "y" * 30_000), (5, long + " " + long[:900] + "z" + long[901:]), (6, long + " " + long[:900] + "z" + long[901:]), (7, "ß" * 7 + " ×÷×÷×÷× " * 2)]
    df = spark.createDataFrame([(*r, "x", 1, "k", 5, "r") for r in rows], DOCS)
    assert variants(spelling_variants.spelling_variants(df)) == variants_of(words_of(rows))
    assert spelling_variants.spelling_variants(df.limit(0)).count() == 0


def test_roots_follow_forms_to_the_last(spark):
    chain = [("abcdefg", 1), ("abcdefgh", 10), ("abcdefghi", 100), ("abcdefghij", 1000)]
    whole = next(d for d in range(99) if all(zlib.crc32(f"{d}:{w}".encode()) % 31 for w, _ in chain))
    found = variants(spelling_variants.spelling_variants(spark.createDataFrame([(whole, " ".join(w for w, n in chain for _ in range(2 * n)))], "doc_id long, text string")))
    assert {(r[0], r[3], r[5]) for r in found} == {(a[0], b[0] if b else None, "abcdefghij") for a, b in itertools.zip_longest(chain, chain[1:])}


def test_keys_are_those_of_the_shorter_words():
    words = ["abcabc", "aab", "éÿab", "xxx"]
    own, of, without, first, last = spelling_variants.deletion_keys(words)
    cuts = [(k, i) for k, w in enumerate(words) for i in range(len(w)) if i == 0 or w[i] != w[i - 1]]
    assert [(k, i) for k, i in zip(of, first, strict=True)] == cuts
    assert [*spelling_variants.deletion_keys([words[k][:i] + words[k][i + 1 :] for k, i in cuts])[0]] == [*without]
    assert all({*words[k][i : j + 1]} == {words[k][i]} and words[k][j + 1 : j + 2] != words[k][i] for k, i, j in zip(of, first, last, strict=True))
    assert len({*own}) == len(words)


# ---- conversation repair


def least_repair(turns):
    """All edit strings by dynamic programming over (turns read, state), as (cost, audit)."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {(0, 0): (0, "")}
    for i in range(len(turns) + 1):
        for _ in range(3):
            for q in range(4):
                for c in "ua":
                    if (i, q) in best and c in after[q]:
                        cost, edits = best[i, q]
                        best[i, after[q][c]] = min(best.get((i, after[q][c]), (10**9, "")), (cost + 5, edits + "I"))
        if i < len(turns):
            initial, must_go, cut = turns[i]
            for q in range(4):
                if (i, q) not in best:
                    continue
                cost, edits = best[i, q]
                ways = [(q, cost + 2, "D")]
                if not must_go:
                    ways += [(after[q][initial], cost + 5 * cut, "K")] if initial in after[q] else []
                    ways += [(after[q][c], cost + 1 + 5 * cut, "R") for c in "ua" if c in after[q]]
                for to, n, e in ways:
                    best[i + 1, to] = min(best.get((i + 1, to), (10**9, "")), (n, edits + e))
    return min(best[len(turns), q] for q in (0, 3) if (len(turns), q) in best)


def test_every_short_conversation_is_repaired_at_least_cost():
    kinds = [(c, False, cut) for c in "suax" for cut in (False, True)] + [("u", True, False)]
    for n in range(5):
        for turns in itertools.product(kinds, repeat=n):
            assert conversation_repair.audit([*turns]) == least_repair(turns)


@pytest.mark.parametrize("seed", range(40))
def test_long_conversations_are_repaired_at_least_cost(seed):
    rng = random.Random(seed)
    turns = [(rng.choice("suuaax"), rng.random() < seed / 60, rng.random() < seed / 80) for _ in range(300)]
    assert conversation_repair.audit(turns) == least_repair(turns)


def test_repaired_turns_keep_to_the_grammar():
    rng = random.Random(9)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "tool", " "]), rng.choice(["a.", "b!", "", "c", " \n", "d?"])) for _ in range(rng.randrange(9))]
        *_, edits, out = conversation_repair.repair([None] * len(rows), rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in out))
        kept = [r for r, e in zip(rows, edits.replace("I", ""), strict=True) if e == "K"]
        assert kept == [(t["role"], t["text"]) for t, e in zip(out, edits.replace("D", ""), strict=True) if e == "K"]


def test_a_conversation_of_many_turns():
    turns = [("u", False, False), ("u", False, True)] * 5_000
    cost, edits = conversation_repair.audit(turns)
    assert len(edits) >= len(turns) and cost == least_repair(turns)[0]


def test_repair_of_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, 5, None, None), (1, 5, "assistant", "Yes."), (None, 1, "user", "Q?"), (None, 2, "assistant", "A"), (2, 1, "user", ""), (3, 7, "user", "One."), (3, 7, "user", "One."), (3, 9, "assistant", "Two!")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    out = {r.conv_id: r for r in conversation_repair.repair_conversations(df).collect()}
    assert (out[1].gaps, out[1].blank, out[1].illegal, out[1].cost, out[1].audit) == (0, 1, 2, 2, "KDK")
    assert (out[None].truncated, out[None].cost, out[None].audit) == (1, 4, "DD")
    assert (out[2].blank, out[2].cost, out[2].audit, out[2].repaired) == (1, 2, "D", [])
    assert (out[3].gaps, out[3].duplicate, out[3].cost, out[3].audit) == (1, 1, 2, "KDK")
    assert conversation_repair.repair_conversations(df.limit(0)).count() == 0
    gone = conversation_repair.repair_conversations(df.withColumn("there", F.lit(False))).collect()
    assert {r.conv_id for r in gone} == {1, 2, 3, None} and all(r.cost == r.gaps == 0 and r.audit == "" and r.repaired == [] for r in gone)


def test_damage_is_dealt_by_the_hash(spark):
    rows = [(c, t, "assistant", "Say. So!") for c in range(40) for t in [None, *range(6)]]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in conversation_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("there").collect())
    want = Counter()
    for c, t, role, text in rows:
        h = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if h:
            want[c, t, "user" if h == 4 else role, "" if h == 1 else "Say So" if h == 2 else text] += 2 if h == 3 else 1
    assert got == want


# ---- packing


def held(spark, df, capacity=2048):
    """The rows of the result, after a check of what holds for any packing."""
    rows = df.withColumn("n", (F.length("ids") / 4).cast("long")).collect()
    sequences = {}
    for r in rows:
        assert r.n == r.length > 0
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
        padding += 0 if end & (end - 1) == 0 else capacity - end
    assert padding * packing.SPARE <= sum(r.length for r in rows)
    return rows


def document_ids(rows):
    """Tokens of each document from its pieces, which follow one another."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        have = out.setdefault(r.doc_id, [])
        assert r.start == len(have)
        have += [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert len(have) <= r.doc_tokens
    assert all(len(out[r.doc_id]) == r.doc_tokens for r in rows)
    return out


def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_packed_documents_hold_the_library_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = held(spark, packing.pack_documents(docs.repartition(3, "doc_id"), queries.TOKENIZER))
    lib = library()
    assert document_ids(rows) == {d.doc_id: [*lib.encode(d.text or "", add_special_tokens=False).ids, 1] for d in docs.collect()}
    out = queries.op13_packing(spark, SF).collect()
    assert {(r.doc_id, r.start, r.length): r.ids_crc32 for r in out} == {(r.doc_id, r.start, r.length): zlib.crc32(r.ids) for r in packing.pack_documents(docs, queries.TOKENIZER).collect()}


def test_packing_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 9000), (5, "y" * 30_000), (6, "é🙂 <|endoftext|> ΑΣ İ ﬁ a\x1cb　c"), (7, "It's a 2-for-1 deal!!! #top $$$ don't, we'll…")]
    df = spark.createDataFrame([(*r, "x", 1, "k", 5, "r") for r in rows], DOCS).coalesce(1)
    lib = library()
    want = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    assert document_ids(held(spark, packing.pack_documents(df, queries.TOKENIZER))) == want
    twice = held(spark, packing.pack_documents(df.union(df).coalesce(1), queries.TOKENIZER))
    assert Counter(r.doc_id for r in twice) >= Counter({d: 2 for d in want}) and sum(r.length for r in twice) == 2 * sum(map(len, want.values()))
    assert packing.pack_documents(df.limit(0), queries.TOKENIZER).count() == 0


@pytest.mark.parametrize("sizes", [[], [5], [2048] * 3, [1500] * 40, [2047, 2], [1] * 5000, [*range(1, 2048)], [4096, 1, 6000]])
def test_windows_hold_each_token_once(sizes):
    out = [*packing.pack_stream(enumerate(sizes), batch=300)]
    seen = Counter()
    for pieces in out:
        n = sum(p[2] for p in pieces)
        assert n <= 2048
        seen.update((d, i) for d, start, length in pieces for i in range(start, start + length))
    assert seen == Counter((d, i) for d, n in enumerate(sizes) for i in range(n))
    padding = sum(2048 - n for p in out if (n := sum(x[2] for x in p)) & (n - 1))
    assert padding * packing.SPARE <= sum(sizes)


def test_differencing_gives_near_equal_windows():
    rng = random.Random(3)
    for k in (1, 2, 5, 40):
        sizes = [rng.randrange(1, 100) for _ in range(40 * k)]
        windows = packing.difference(sizes, k)
        assert sorted(i for w in windows for i in w) == [*range(len(sizes))] and len(windows) == k
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= 3
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]  # the textbook case


def test_words_are_the_same_with_a_small_memory():
    content = open(queries.TOKENIZER, "rb").read()
    bpe, lib = packing.BatchBpe(content, most_words=50), library()
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdeéüΣ1.,'!*") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(5)] + ["z" * 100]
        assert [[int.from_bytes(x[k : k + 4], "little") for k in range(0, len(x), 4)] for x in bpe.encode_many(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
