"""Cross-tokenizer alignment against the libraries' own tokens and plain loops."""

import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoglass.llm import alignment
from chronoglass.llm.tokens import public

A, B = public("byte_bpe_50k.json"), public("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, rid string, pairs string, a_ids string, pair int"
TEXTS = [
    None, "", " ", "  ", "\n", "a", "hello world", "Hello  there,\n\nGeneral. ", " leading", "tab\tand\r\nend\n", "<|endoftext|> is <s>plain</s> <unk> text<|endoftext|>", "naïve café Straße", "漢字とかな混じり", "Привет, мир! 😀👩‍👩‍👧", "▁ is not a space▁", "x" * 3000,
    "supercalifragilistic antidisestablishmentarianism", "\x00\x01\x7f", "\x1c\x1d a b　c", "12345 67.89 1e-9", "é ﬁ ​", "the the the the the", "<0x41> <0x0A>", "it's we'll I'M don't", "a" + " b" * 3000, "end with line\nx \n y\n",
]


@lru_cache(1)
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_level(token):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    table = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    return bytes(table[c] for c in token)


def tokens(text):
    if not text:
        return [], []
    tok, sp = libraries()
    e = tok.encode(" " + text, add_special_tokens=False)
    a = [(i, byte_level(tok.id_to_token(i))) for i in e.ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and sp.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def ranges(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    docs = []
    for i, text in rows:
        a, b = map(ranges, tokens(text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        inside = lambda side, low, high: ",".join(str(t) for t, _, e in side if low < e <= high)
        groups = [f"{inside(a, low, high)}|{inside(b, low, high)}" for low, high in zip([0, *cuts], cuts, strict=False)] if len(cuts) < 500 else None
        k, links = 0, []
        for t, s, e in a:
            while b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((t, b[j][0]))
                j += 1
        docs.append((i, a, b, cuts, groups, links))
    held = Counter(p for d in docs for p in set(d[5]))
    best = defaultdict(int)
    for (t, _), n in held.items():
        best[t] = max(best[t], n)
    return [(i, len(a), len(b), len(cuts), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), None if groups is None else hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for i, a, b, cuts, groups, links in docs]


def df_of(spark, rows):
    return spark.createDataFrame([(*r, "r", "p", "a", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_against_loops(spark, sf_dir, limit):
    rows = [*enumerate(TEXTS), (2, TEXTS[6]), (2, TEXTS[6]), (None, "nobody's text"), (None, None)]
    rows += [(r.doc_id + 1000, r.text[:2500]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    got = alignment.alignment(df_of(spark, rows).repartition(4), A, B, broadcast_pairs=limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:7])
    got, want = sorted(map(tuple, got.collect()), key=order), sorted(brute(rows), key=order)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want, strict=True))
    assert sum(w[1] > 0 for w in want) > 70 and any(w[1] == 0 for w in want)


def test_nothing(spark):
    assert alignment.alignment(df_of(spark, []), A, B).count() == 0
    assert alignment.alignment(df_of(spark, [(7, None)]), A, B).collect()[0] == (7, 0, 0, 0, 0, 0, 0, "")


WORDS = st.lists(st.sampled_from(["the", "Thing", "é", "漢", " ", "  ", "\n", "\n\n", "\t", "▁", "<s>", "x1", "'ll", " ", "\x1c", "😀", "ß", "<0x41>", "\r"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(WORDS, st.text(max_size=20), st.text(st.characters(max_codepoint=0x900), max_size=30)))
def test_tokens_are_the_libraries(text):
    tok, sp = libraries()
    raw = (" " + text).encode()
    for kind, path, ids in (("a", A, tok.encode(" " + text, add_special_tokens=False).ids), ("b", B, sp.encode(text))):
        side = alignment.side(kind, path)
        assert not text or side.ids(text).tolist() == ids
        assert not raw or kind == "b" or b"".join(side.bytes[i] for i in ids) == raw


def test_cut_at_spaces_or_whole(spark):
    """Texts with all kinds of white space by spaces, in one batch, so that units are shared among them."""
    draw = np.random.default_rng(5)
    parts = ["the", "Thing", "é", "漢", " ", " ", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", "▁", "x1", "'ll", "\x1c", "😀", "<0x41>", "\r", ".", "ɐ"]
    rows = [(i, "".join(draw.choice(parts, draw.integers(1, 14)))) for i in range(600)]
    order = lambda r: r[0]
    assert sorted(map(tuple, alignment.alignment(df_of(spark, rows).coalesce(1), A, B).collect()), key=order) == sorted(brute(rows), key=order)


def test_a_word_is_encoded_once(monkeypatch):
    """Of a batch's words, each different one goes to the tokenizers once, and slices of it give the same."""
    seen = []

    class Watched:
        def __init__(self, side):
            self.side = side

        def __getattr__(self, name):
            return getattr(self.side, name)

        def ids(self, text):
            seen.append(len(text))
            return self.side.ids(text)

    sides = {"a": Watched(alignment.side("a", A)), "b": Watched(alignment.side("b", B))}
    monkeypatch.setattr(alignment, "side", lambda kind, path: sides[kind])
    texts = [" ".join(f"word{(i + k) % 50}" for k in range(200)) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"rid": pa.array(range(42)), "doc_id": pa.array(range(42)), "text": pa.array([*texts, None, "two  spaces"])})
    once = [r for b in alignment._align(A, B)(iter([batch])) for r in b.to_pylist()]
    assert sum(seen) <= 2 * (50 * 7 + 11)
    monkeypatch.setattr(alignment, "SLICE", 3000)
    assert sorted((r for b in alignment._align(A, B)(iter([batch])) for r in b.to_pylist()), key=lambda r: r["rid"]) == sorted(once, key=lambda r: r["rid"])
    assert [r["n_groups"] > 0 for r in sorted(once, key=lambda r: r["rid"])] == [True] * 40 + [False, True]
