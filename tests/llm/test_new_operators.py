"""Prefix trie, BPE and conversation repair: brute force, the library's own results, edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitrank.llm import bpe, prefixtrie, queries, repair
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id bigint, turn bigint, role string, text string, node string, chain int"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_repair"])
def test_query_equals_its_sql(spark, name):
    ok, message = compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert ok, message


# --- prefix trie ---------------------------------------------------------------------------------------


def trie_by_hand(conversations: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == len(path))
        out.add((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(conversations: dict[int, list[tuple[str, str]]]) -> dict[int, list[tuple[str, str]]]:
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = conversations.get(c - c % 20, [])[:h] + turns[h:]
    return out


def made_conversations():
    rng = random.Random(5)
    out = {}
    for c in range(0, 420):
        length = rng.choice([1, 1, 2, 3, 4, 9, 17, 40 if c % 50 == 0 else 5])
        out[c] = [(rng.choice(["user", "assistant"]), rng.choice(["a b", "a b c", "", "x\ty z", "long " * 5])) for _ in range(length)]
    for c in range(600, 700):  # copies of one conversation
        out[c] = [("user", "the same"), ("assistant", "again and again"), ("user", "!")]
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_trie_equals_brute_force_over_any_shards(spark, partitions):
    made = made_conversations()
    rows = [(c, i, r, t, "clash", 1) for c, turns in made.items() for i, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in prefixtrie.prefix_trie(prefixtrie.with_shared_starts(prefixtrie.turn_sequences(frame))).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    want = trie_by_hand(rebuilt(made))
    assert len(got) == len(want) and set(got) == want


def test_trie_edge_cases(spark):
    rows = [(7, 0, None, None, "c", 1), (7, None, "user", "first", "c", 1), (8, 0, "", "", "c", 1), (None, 0, "user", "no id", "c", 1), (40, 0, "user", "word " * 50_000, "c", 1)]
    frame = spark.createDataFrame(rows, TURNS)
    plain = prefixtrie.turn_sequences(frame)
    got = {tuple(r) for r in prefixtrie.prefix_trie(plain).collect()}
    assert got == trie_by_hand({7: [("user", "first"), ("", "")], 8: [("", "")], 40: [("user", "word " * 50_000)]})
    # 2 loses its only turn and its leader is absent: it ends at the root.
    lost = next(c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    only = spark.createDataFrame([(lost, 0, "user", "x", "c", 1)], TURNS)
    got = [tuple(r) for r in prefixtrie.prefix_trie(prefixtrie.with_shared_starts(prefixtrie.turn_sequences(only))).collect()]
    assert got == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]
    assert prefixtrie.prefix_trie(prefixtrie.with_shared_starts(prefixtrie.turn_sequences(frame.where("false")))).count() == 0


# --- BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_segment_tree_yields_the_leftmost_least():
    rng = random.Random(2)
    for n in (1, 2, 5, 8, 33):
        ranks = [rng.choice([None, 3, 1, 7]) for _ in range(n)]
        tree = bpe.PairTree(ranks)
        for _ in range(40):
            known = [(r, i) for i, r in enumerate(ranks) if r is not None]
            assert tree.least() == (min(known)[1] if known else None)
            at = rng.randrange(n)
            ranks[at] = rng.choice([None, 0, 2, 5])
            tree.put(at, ranks[at])


def test_ids_and_decoded_text_equal_the_library(library):
    rng = random.Random(4)
    letters = [*"ab'stred lm vΣσ ÀȨ́́  \x1c|é日本12٣½ǅİ\x00🎉‍\n\t<>", "<|endoftext|>", "<|startoftext|>", "'re", "the", "ing"]
    texts = ["", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "x" * 5000, "".join(rng.choice("etaoin") for _ in range(9000)), "word " * 9000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    own = bpe.WordBPE(PATH)
    import pyarrow as pa

    made = [list(parts) for parts in own.batch(pa.array(texts))]
    for text, parts in zip(texts, made, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(p[0] for p in parts), "<u4").tolist() == want == own.encode(text), text
        assert " ".join(p[1] for p in parts if p[0]) == library.decode(want, skip_special_tokens=False)


def test_pieces_of_long_texts_and_a_full_cache_change_nothing(library, monkeypatch):
    text = " ".join(f"w{i}ing" for i in range(3000)) + "\n" + "q" * 700 + " end"
    monkeypatch.setattr(bpe, "SPAN", 97)
    monkeypatch.setattr(bpe, "CACHED_RUNS", 50)
    assert bpe.WordBPE(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, library):
    rows = {r.doc_id: r for r in queries.op12_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(rows[d.doc_id]) == (d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_edge_cases(spark, library):
    frame = spark.createDataFrame([(1, None, "clash"), (1, "", "clash"), (2, "A  b\n", "clash"), (2, "A  b\n", "clash")], "doc_id bigint, text string, IDS string")
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_texts(frame, PATH).collect())
    ids = library.encode("A  b\n", add_special_tokens=False).ids
    assert got == [(1, 0, b"", "")] * 2 + [(2, 2, np.array(ids, "<u4").tobytes(), "a</w> b</w>")] * 2
    assert bpe.encode_texts(frame.where("false"), PATH).count() == 0


# --- repair ------------------------------------------------------------------------------------------------


def repaired_by_hand(rows: list[tuple[str, str, int]]) -> tuple[int, str, str]:
    """Cheapest, then ASCII-least edits, over every string of edits of limited length."""
    best = None

    def walk(at, cost, audit, roles, told):
        nonlocal best
        if best and cost > best[0]:
            return
        if at == len(rows):
            whole = "".join(roles)
            if re.fullmatch(r"(s?(ua)+)?", whole) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(told)
        if audit.count("I") <= len(rows) + 2:
            for role in ("user", "assistant"):
                walk(at, cost + 3, audit + "I", [*roles, role[0]], [*told, f"{role}:"])
        if at < len(rows):
            role, text, fault = rows[at]
            walk(at + 1, cost + 4, audit + "D", roles, told)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                extra = 3 if fault == repair.TRUNCATED else 0
                walk(at + 1, cost + extra, audit + "K", [*roles, role[:1] or "?"], [*told, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    walk(at + 1, cost + 3 + extra, audit + "R", [*roles, other[0]], [*told, f"{other}:{text}"])

    best = (4 * len(rows), "D" * len(rows), "")
    walk(0, 0, "", [], [])
    return best


def test_cheapest_edits_equal_exhaustive_search(spark, monkeypatch):
    monkeypatch.setattr(repair, "SETTLE", 2)
    rng = random.Random(9)
    cases = [list(c) for n in range(4) for c in itertools.product(["system", "user", "assistant", "tool"], repeat=n)]
    cases += [[rng.choice(["system", "user", "assistant", "", "user"]) for _ in range(5)] for _ in range(40)]
    for roles in cases:
        rows = [(r, f"t{i}{rng.choice('.x')}", rng.choice([0, 0, 0, 1, 2, 3])) for i, r in enumerate(roles)]
        one = repair.Conversation(1)
        for i, row in enumerate(rows):
            one.add(i, *row)
        cost, audit, told = repaired_by_hand(rows)
        assert one.result()[6:] == (cost, audit, hashlib.sha256(told.encode()).hexdigest()), rows


def test_order_of_shared_strings(monkeypatch):
    rng = random.Random(1)
    for factor in (repair._FACTOR, 0):  # a factor of 0 makes almost all hashes equal: only the verification is left
        monkeypatch.setattr(repair, "_FACTOR", factor)
        root = repair.Edit(None, "")
        made = {"": root}
        for _ in range(300):
            start = rng.choice(sorted(made))
            letter = rng.choice("DIKR")
            made.setdefault(start + letter, repair.Edit(made[start], letter))
        for _ in range(600):
            a, b = rng.choice(sorted(made)), rng.choice(sorted(made))
            assert repair.less(made[a], made[b]) == (a < b)
            assert repair.letters(made[a]) == a and all(repair.letters(made[a].above(d)) == a[:d] for d in range(len(a) + 1))
            assert repair.common_prefix(made[a], made[b]) <= len(a)


def test_long_conversations_settle(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}.", "c", 1) for i in range(3000)] + [(2, None, None, None, "c", 1), (None, 5, "user", "hi.", "c", 1), (None, 7, "assistant", "yes.", "c", 1)]
    got = {r.conv_id: r for r in repair.repair_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    audit = got[1].audit
    assert len(audit.replace("I", "")) == 3000 and got[1].gaps == 0 and got[1].cost == 3 * (audit.count("I") + audit.count("R")) + 4 * audit.count("D")
    assert (got[2].blank, got[2].audit, got[2].cost, got[2].gaps) == (1, "D", 4, 0)
    assert (got[None].audit, got[None].gaps, got[None].repaired_sha256) == ("KK", 1, hashlib.sha256(b"user:hi.\nassistant:yes.").hexdigest())
    assert repair.repair_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_lost_conversation_is_reported(spark):
    frame = spark.createDataFrame([(3, 0, "user", "x", False), (4, 0, "user", "same", True), (4, 0, "user", "same", True)], "conv_id bigint, turn bigint, role string, text string, present boolean")
    got = {r.conv_id: tuple(r) for r in repair.repair_conversations(frame).collect()}
    assert got[3] == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[4][3] == 1 and got[4][7] == "DD"


def test_damage(spark):
    def kind(c, t):
        return zlib.crc32(f"{c}:{t}".encode()) % 20

    at = {k: next(t for t in range(2000) if kind(1, t) == k) for k in range(6)}
    frame = spark.createDataFrame([(1, t, "assistant", "a.b!", "c", 1) for t in at.values()], TURNS)
    got = {k: sorted((r.role, r.text, r.present) for r in repair.damaged(frame).where(F.col("turn") == t).collect()) for k, t in at.items()}
    plain = ("assistant", "a.b!", True)
    assert got == {0: [("assistant", "a.b!", False)], 1: [("assistant", "", True)], 2: [("assistant", "ab", True)], 3: [plain, plain], 4: [("user", "a.b!", True)], 5: [plain]}
