"""Vector codes, source divergence and BPE against plain Python and the tokenizers library."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plover.llm import bpe, divergence, vector_codes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(id, label, vector) rows to {id: (code, error)} and the codebooks' digest, one vector at a time."""
    kept = [(i, label, [int(np.floor(4096 * float(np.float32(x)))) for x in v]) for i, label, v in rows]
    kept.sort(key=lambda r: (r[0], r[2]))
    w = len(kept[0][2]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, _, v in kept]
    books = [[cut[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        met = [[best(row[p], books[p])[1] for p in range(parts)] for row in cut]
        for p in range(parts):
            groups = defaultdict(list)
            for row, m in zip(cut, met, strict=True):
                groups[m[p]].append(row[p])
            for e, found in groups.items():
                books[p][e] = [sum(x) // len(found) for x in zip(*found, strict=True)]
    final = [[best(row[p], books[p]) for p in range(parts)] for row in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, label, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, label, _), f in zip(kept, final, strict=True)], digest


def vectors_of(spark, rows):
    made = [(i, v, label, "x", 1) for i, label, v in rows]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>, label int, code string, error int")


def test_nearest_is_exact_with_ties_to_the_lower_index():
    rng = np.random.default_rng(4)
    for wide, spread in ((1, 3), (4, 2), (8, 50)):
        rows, book = rng.integers(-spread, spread + 1, (500, wide)), rng.integers(-spread, spread + 1, (16, wide))
        book[7] = book[2]
        index, distance = vector_codes.nearest(rows, book)
        every = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_vector_codes_match_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [None, 0, 1, 1][i % 4], (rng.normal(size=16) * [1, 0.001][i % 2]).tolist()) for i in range(60)]
    rows += [(100, 2, rows[3][2]), (101, 2, rows[3][2]), (101, 2, rows[3][2]), (-7, 1, [0.0] * 16)]
    odd = [(200, 1, None), (201, 1, [1.0] * 15 + [None]), (202, 1, [float("nan")] * 16), (203, None, [float("inf")] * 16), (204, 1, []), (205, 1, [1.0] * 8), (206, 1, [1.0] * 9)]
    got = vector_codes.vector_codes(vectors_of(spark, rows + odd)).collect()
    want, digest = plain_codes(rows)
    errors = Counter()
    for _, label, _, error in want:
        errors[label] += error
    assert sorted((r["id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted((i, c, e, errors[label]) for i, label, c, e in want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_vector_codes_of_few_null_and_no_vectors(spark):
    few = vector_codes.vector_codes(vectors_of(spark, [(3, 1, [1.0] * 8), (None, None, [0.5] * 8)])).collect()
    assert sorted((str(r["id"]), r["code"], r["error"], r["label_error"]) for r in few) == [("3", "00" * 8, 0, 0), ("None", "01" * 8, 0, 0)]
    for rows in ([], [(1, 1, None), (2, 1, [None])]):
        none = vector_codes.vector_codes(vectors_of(spark, rows))
        assert none.columns == ["id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(vectors_of(spark, [(1, 1, [1e12] * 8)])).collect()


# Source divergence


def plain_divergence(rows, least=10, top=10):
    found, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text))
        groups.add((lang, source))
        found[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        v = len(kept)

        def p_of(counts, kept=kept, v=v):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine = p_of(found[lang, source])
        whole = p_of(sum((found[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in groups:
            if other[0] == lang and other != (lang, source):
                theirs = p_of(found[other])
                pairs.append((-sum(f(mine[t], theirs[t]) for t in kept), other[1]))
        terms = [(-f(mine[t], whole[t]), t) for t in kept if found[lang, source][t] and mine[t] > whole[t]]
        for part, ranked in (("pair", pairs), ("term", terms)):
            ranked = sorted(ranked, key=lambda r: (r[0], r[1].encode()))
            out += [(lang, source, part, item, -value, k) for k, (value, item) in enumerate(ranked[: None if part == "pair" else top], 1)]
    return sorted(out)


def divergence_docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "y", 2) for r in rows], "text string, lang string, source string, rank int, term string, n int")


@pytest.mark.parametrize("block", [3, 2048])
def test_divergence_matches_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 50)
    rng = random.Random(block)
    vocabulary = ["the", "The", "a", "ab", "abc", "abcd", "ü", "üb", "日本", "日", "née", "\u0080x", "zz", "tie1", "tie", "tiE"] + [f"{a}{b}" for a in "pqr" for b in "stuv"]
    rows = []
    for k in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", "", None, "é"])
        words = [rng.choice(vocabulary[: 10 + 3 * (k % 7)]) for _ in range(rng.randrange(12))]
        rows.append((rng.choice([" ", "-", "1", "\x00"]).join(words) or None, lang, source))
    rows += [("solo", "fr", "s1"), (None, "fr", "s2"), ("", "it", "only")] + [("same same", "es", s) for s in "ab" for _ in range(6)] * 2
    got = divergence.source_divergence(divergence_docs(spark, rows), block=block).collect()
    assert sorted(map(tuple, got)) == plain_divergence(rows)


def test_divergence_of_an_empty_table(spark):
    assert divergence.source_divergence(divergence_docs(spark, [])).count() == 0


def test_radix_trie_splits_edges_and_walks_in_byte_order():
    rng, want = random.Random(1), Counter()
    for _ in range(3000):
        want[bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.randrange(1, 7)))] += 1
    trie = divergence.RadixTrie.of_sorted((t, [n, {"s": 2 * n}]) for t, n in sorted(want.items()))
    assert list(trie.walk()) == [(t, [n, {"s": 2 * n}]) for t, n in sorted(want.items())] and trie.leaves == len(want)

    def edges(node):
        return sum(1 + edges(child) for child in node[1].values())

    assert edges(trie.root) < 2 * len(want) and all(len(n[1]) > 1 or n[2] is not None for n in trie.root[1].values())


def test_shares_are_exact_where_a_product_would_overflow():
    counts, totals = np.array([[10**12 + 1, 3]]), np.array([7 * 10**13 + 3, 10**14])
    want = [[1 + 1_000_000_000 * int(c) // int(t) for c, t in zip(counts[0], totals, strict=True)]]
    assert divergence.shares(counts, totals).tolist() == want


# BPE


def odd_texts():
    rng = random.Random(9)
    alphabet = ["word", "Ünï", " ", "  ", "\n", "\t ", " ", "　", "日本語", "!?", "don't", "we'LL", "123", "<|endoftext|>", "<|endo", "\x00", "\U0001f600", "é", " ", "\x1c", "'s"]
    texts = ["", " ", "   ", "a", "<|endoftext|>", "a  <|endoftext|> b", "x" * 30_000, " " * 30_000, "日" * 9_000, "ab " * 20_000, "\n\n".join(["same line"] * 3_000), None]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(60)]
    passage = " ".join(f"w{rng.randrange(900)}" for _ in range(900))
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(300))) + sep + passage for sep in ("", " ", "  ", "\n", "x") for _ in range(4)]
    return texts + [texts[-1]] * 5


@pytest.mark.parametrize("how", [bpe.Cutting(), bpe.Cutting(bits=3, least=4, most=64)])
def test_bpe_equals_the_tokenizers_library(spark, how):
    texts = odd_texts()
    docs = spark.createDataFrame([(None if i % 9 == 8 else i // 2, t, b"k", "b") for i, t in enumerate(texts)], "doc_id long, text string, text_key binary, body string").repartition(3)
    got = bpe.encode_texts(docs, VOCABULARY, how, with_ids=True).collect()
    plain, want = Tokenizer.from_file(VOCABULARY), []
    for i, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False).encode()
        raw = np.array(ids, "<u4").tobytes()
        want.append((None if i % 9 == 8 else i // 2, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest(), raw, back))
    order = lambda r: (str(r[0]), r[1:])
    assert sorted(((r["id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"]), bytes(r["decoded"])) for r in got), key=order) == sorted(want, key=order)


def test_bpe_encodes_a_shared_chunk_once(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef gh") for _ in range(20_000))
    texts = [f"start {k} {passage} end {k}" for k in range(12)]
    how, code = bpe.Cutting(), bpe.coder(VOCABULARY)
    held = [{bpe.chunk_key(c) for c in bpe._chunks(code, t, how)} for t in texts]
    assert len(set.intersection(*held)) >= 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bpe.encode_texts(docs, VOCABULARY).count() == 12


def test_cuts_cover_the_text_and_keep_characters_whole():
    rng = random.Random(3)
    for text in ("", "a", "日本" * 5_000, "".join(chr(rng.randrange(32, 0x3000)) for _ in range(5_000))):
        data = text.encode()
        ends = bpe.cuts(data, bpe.Cutting(bits=4, least=8, most=100))
        parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert b"".join(parts) == data and "".join(p.decode() for p in parts) == text and max(map(len, parts)) <= 100


def test_bpe_of_an_empty_table(spark):
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
