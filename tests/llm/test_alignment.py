import hashlib
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marketlake.llm import alignment


@pytest.fixture(scope="module")
def pair():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as spec, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        return alignment.ByteLevel(spec.read(), public_tokenizers.PATTERN), alignment.Pieces(model.read())


@pytest.fixture(scope="module")
def libraries():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(rest)): b for b in range(256)}


def tokens(text, libraries):
    """(id, start, end) of both cuts, or nothing."""
    whole, pieces = libraries
    letters, plain, out = byte_letters(), (" " + text).encode(), []
    if not text:
        return [], []
    for ids, told in ((whole.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in whole.id_to_token(i))), (pieces.encode(text), lambda i: bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", pieces.id_to_piece(i))) else pieces.id_to_piece(i).replace("▁", " ").encode())):
        at, cut = 0, []
        for i in ids:
            cut.append((i, at, at + len(told(i))))
            at = cut[-1][2]
        if b"".join(map(told, ids)) != plain:
            return [], []
        out.append(cut)
    return out


def brute_force(texts, libraries):
    """Digest columns of each text, by comparing every token with every token of one group."""
    found, count = [], Counter()
    for text in texts:
        a, b = tokens(text or "", libraries)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links, written, shared = [], [], 0
        group = [defaultdict(list), defaultdict(list)]
        for held, cut in zip(group, (a, b)):
            for t in cut:
                held[bisect_right(ends, t[1])].append(t)
        for k in range(len(ends)):
            x, y = group[0][k], group[1][k]
            links += [(s[0], t[0]) for s in x for t in y if s[1] < t[2] and t[1] < s[2]]
            written.append(",".join(str(s[0]) for s in x) + "|" + ",".join(str(t[0]) for t in y))
            shared += len(x) * len(y)
        count.update(set(links))
        found.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(written).encode()).hexdigest() if a else "", shared))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [(n_a, n_b, n, len(ls), sum(count[x] == top[x[0]] for x in ls), sum(count[x] for x in ls), sha, shared) for n_a, n_b, n, ls, sha, shared in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]


def check(docs, pair, libraries):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(rows, brute_force([r["text"] for r in rows], libraries))), key=str)
    got = sorted((tuple(r) for r in alignment.align(docs, *pair).select("doc_id", *COLUMNS).collect()), key=str)
    assert got == want
    return got


def test_against_brute_force(docs, pair, libraries):
    # the brute force takes seconds for each long text
    short = docs.filter("length(text) < 20000")
    assert len(check(short, pair, libraries)) > 150


def test_odd_rows(spark, odd, empty, pair, libraries):
    more = spark.createDataFrame([(20, "<|endoftext|> a <s>"), (21, "tab\tand  blanks \n"), (22, "日本語 ﬁ ½ ＡＢ"), (23, " lead"), (24, " x y"), (25, "naïve Привет ψ"), (26, "\x00\x1f\x7f")], "doc_id long, text string")
    got = check(odd.select("doc_id", "text").union(more), pair, libraries)
    assert len(got) == 20 and any(g[1] == 0 for g in got)
    assert alignment.align(empty, *pair).count() == 0


def test_both_libraries_agree_on_the_letters_of_the_short_way(pair, libraries):
    for c in map(chr, range(alignment.ByteLevel.ALIKE)):
        for text in (c, f" a{c}b {c}{c}1{c} ", f"{c} {c}'s  {c}\n"):
            assert pair[0].encode(text) == libraries[0].encode(text, add_special_tokens=False).ids


def test_products_against_dense_matrices():
    rng = np.random.default_rng(2)
    old, alignment.BLOCK_ROWS = alignment.BLOCK_ROWS, 7
    try:
        for _ in range(30):
            dense = [(rng.random(shape) < 0.3).astype(int) for shape in ((20, 15), (18, 15))]
            a, b = (alignment.Rows(np.append(0, np.cumsum(d.sum(axis=1))), np.nonzero(d)[1]) for d in dense)
            turned = alignment.transposed(b, 15)
            out = np.zeros((20, 18), int)
            for row, column, value in alignment.row_products(a, turned):
                out[row, column] = value
            assert (out == dense[0] @ dense[1].T).all()
            assert (alignment.row_sizes(a, turned) == out.sum(axis=1)).all()
    finally:
        alignment.BLOCK_ROWS = old


def test_links_themselves(spark, pair, libraries):
    text = "Unbelievably, the tokenization differs."
    docs = spark.createDataFrame([(5, text), (6, None)], "doc_id long, text string")
    a, b = tokens(text, libraries)
    overlap = {(i, j, s[0], t[0], min(s[2], t[2]) - max(s[1], t[1])) for i, s in enumerate(a) for j, t in enumerate(b) if s[1] < t[2] and t[1] < s[2]}
    assert {tuple(r)[1:] for r in alignment.token_links(docs, *pair).collect()} == overlap
    ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
    group = lambda t: sum(e <= t[1] for e in ends)
    shared = {(i, j, s[0], t[0], 1) for i, s in enumerate(a) for j, t in enumerate(b) if group(s) == group(t)}
    assert {tuple(r)[1:] for r in alignment.token_links(docs, *pair, shared_groups=True).collect()} == shared and overlap <= shared | overlap
