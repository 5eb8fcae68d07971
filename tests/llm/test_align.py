"""Linked tokens against a direct version on whole texts with the libraries' own encoders."""

import hashlib
import random
from collections import Counter

import pytest

from issuelens.llm import align
from issuelens.llm.common import table
from tests.llm.test_operators import frame, prose

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def encoders():
    first = tokenizers.Tokenizer.from_file(f"{align.FOLDER}/{align.FIRST}")
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.SECOND}")


def plain_tokens(encoders, text):
    """([(id, end)], [(id, end)]) by whole texts, or two empty lists."""
    first, second = encoders
    letters = align.byte_letters()
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids] if text else []
    b = [(i, second.id_to_piece(i)) for i in second.encode(text)] if text else []
    b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i, p in b]
    wanted = (" " + text).encode() if text else b""
    if b"".join(t for _, t in a) != wanted or b"".join(t for _, t in b) != wanted:
        return [], []
    out = []
    for tokens in (a, b):
        end, ends = 0, []
        for i, t in tokens:
            end += len(t)
            ends.append((i, end))
        out.append(ends)
    return out


def plain_alignment(encoders, texts):
    rows, counts = [], Counter()
    for doc, text in texts:
        a, b = plain_tokens(encoders, text or "")
        both = sorted({e for _, e in a} & {e for _, e in b})
        groups, start = [], 0
        for end in both:
            groups.append(([i for i, e in a if start < e <= end], [i for i, e in b if start < e <= end]))
            start = end
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        counts.update(links.keys())
        rows.append((doc, len(a), len(b), groups, links))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc, n_a, n_b, groups, links in rows:
        listed = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        total = sum(n * counts[p] for p, n in links.items())
        digest = hashlib.sha256(listed.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), best, total, digest))
    return out


PARTS = ["a", " ", "  ", "\n", "\t", "b", "é", "日本", "👍", "1", "'s", "!", "\xa0", " the", "\x1c", "\x85", "​", "é", "ab", "-", "\0"]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    odd = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(1, 40))) for _ in range(300)]
    fixed = [None, "", " ", "  ", "a ", " a  b \n", "x\n \n  y", "▁x y", "▁ y", "<|endoftext|> b", "<s> <unk> <0x41>"]
    fixed += ["=" * 200, " " * 300, "0123456789" * 30, "日本語" * 50, "word " * 200, "\n" * 50]
    rows = [(i, t) for i, t in enumerate([*fixed, *odd, prose(1, 500), prose(1, 500)])]
    return [*rows, (3, "twice"), (3, "twice"), (None, "no id")]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("piece", [align.PIECE, 20])
def test_alignment(spark, encoders, texts, piece):
    got = result(align.align_tokens(frame(spark, texts).repartition(3), block_bytes=2000, piece=piece))
    assert got == sorted(plain_alignment(encoders, texts), key=str)
    assert align.align_tokens(frame(spark, texts).limit(0)).count() == 0
    assert result(align.align_tokens(frame(spark, [(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pieces_join_to_the_text():
    text = " " + prose(3, 400) + "\n  \n x" + "y" * 300 + "  z "
    for most in (1, 7, 100):
        pieces = align.pieces_of(text, most)
        assert "".join(pieces) == text and all(p[0] == " " and not p[-1].isspace() for p in pieces[:-1])


def test_groups_of_many_tokens(encoders):
    """Counting equal ids before the join gives the same pairs."""
    files = [open(f"{align.FOLDER}/{f}", "rb").read() for f in (align.FIRST, align.SECOND)]
    both = align._vocabularies(*files)
    text = " " + "".join(chr(0x2500 + i % 7) + "ab" * (i % 3) for i in range(600))
    owner = align.np.zeros(1, int)
    one = align.linked_tokens(both, [text], owner, 1)
    sides = {(k, n) for _, k, n in zip(*one["pairs"].to_pydict().values())}
    a, b = plain_tokens(encoders, text[1:])
    ends = sorted({e for _, e in a} & {e for _, e in b})
    want, start = Counter(), 0
    for end in ends:
        want.update((x << 32) | y for x, e in a if start < e <= end for y, f in b if start < f <= end)
        start = end
    assert sides == set(want.items())


def test_whole_table(spark, sf_dir, encoders):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    short = [r for r in rows if len(r[1] or "") < 5000]
    got = result(align.align_tokens(docs.where("coalesce(length(text), 0) < 5000")))
    assert got == sorted(plain_alignment(encoders, short), key=str)
