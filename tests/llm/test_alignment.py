import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quiver.llm import alignment
from quiver.llm.bytepair import shown_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain(texts, libraries):
    """Whole texts through the libraries, every pair of tokens compared by its byte range."""
    lib_a, lib_b = libraries
    value = {c: x for x, c in enumerate(shown_bytes())}
    per, links_of = [], []
    for t in texts:
        raw = (" " + (t or "")).encode()
        ta = tb = []
        if t:
            a, b = lib_a.encode(" " + t, add_special_tokens=False).ids, lib_b.encode(t)
            ta = [(i, bytes(value[c] for c in lib_a.id_to_token(i))) for i in a]
            tb = [(i, bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode()) for i in b]
            if b"".join(x for _, x in ta) != raw or b"".join(x for _, x in tb) != raw:
                ta = tb = []
        spans = []
        for tokens in (ta, tb):
            at, s = 0, []
            for i, x in tokens:
                s.append((i, at, at + len(x)))
                at += len(x)
            spans.append(s)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, f in side if start <= s and f <= e) for side in spans))
            start = e
        links = [(i, j) for i, s, e in spans[0] for j, u, f in spans[1] if s < f and u < e]
        links_of.append(links)
        per.append([len(ta), len(tb), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else ""])
    count = Counter(x for links in links_of for x in links)
    top: dict = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [(*p[:4], sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), p[4]) for p, links in zip(per, links_of)]


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()))


def expected(docs, libraries):
    rows = docs.select("doc_id", "text").collect()
    return sorted((r.doc_id is None, r.doc_id or 0, *p) for r, p in zip(rows, plain([r.text for r in rows], libraries)))


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 3])
def test_odd_texts_against_the_libraries(spark, odd_docs, libraries, heavy):
    docs = odd_docs.filter("doc_id is null or doc_id not in (5, 6)")
    assert rows_of(alignment.align(docs, heavy=heavy)) == expected(docs, libraries)


def test_real_documents_against_the_libraries(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 4000")
    assert rows_of(alignment.align(docs)) == expected(docs, libraries)


def test_chunks_are_tokenised_as_in_the_whole_text(libraries):
    """Random strings of white space of all kinds, marks, digits, special tokens and letters of several scripts."""
    rng = random.Random(5)
    bits = [" ", " ", "  ", "   ", "\n", "\n ", " \n", "\t", "　", "\xa0", "\x85", " ", "\x1c", "▁", "a", "word", "Word,", "wörter!?", "aª", "x²", "a_b", "it's", "Straße", "'s", "'ll", "12", "3", "!?", "<|endoftext|>",
            "<s>", "<0x41>", "東京", "👍🏽", "é", "\x00", "​", "x" * 80]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    aligner = alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    want = plain(texts, libraries)
    for t, w, got in zip(texts, want, aligner.texts(texts)):
        assert (w[0] == 0) == (got is None), t
        if got:
            assert (*got[:4], got[4]) == (*w[:4], w[6]), repr(t)


def agree(texts, libraries, aligner):
    for t, w, got in zip(texts, plain(texts, libraries), aligner.texts(texts)):
        assert (w[0] == 0) == (got is None), repr(t)
        if got:
            assert (*got[:4], got[4]) == (*w[:4], w[6]), repr(t)
            assert sum(got[6].tolist()) == got[3] and got[5].tolist() == sorted(set(got[5].tolist()))


def test_units_are_learnt_once_however_they_are_joined(libraries):
    """Words, symbols, digits and line feeds side by side: the table grows with the units, not with their combinations."""
    words = ["".join(x) for x in zip("abcdefghijklmno", "nopqrstuvwxyzab", "ééüaeiouaeiouaei")]
    texts = [f"{a}{end}{b}, {b}{end}{a}" for a in words for b in words for end in (".\n", "-", "12", ")(", "/9.")]
    aligner = alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    agree(texts, libraries, aligner)
    assert len(aligner.table) <= 2 * len(words) + 10


def test_kinds_of_characters_side_by_side(libraries):
    """Random strings of every ASCII character, letters around the bounds of the plain ones, white space of all kinds and long runs."""
    rng = random.Random(9)
    chars = [chr(c) for c in range(128)] + list("\x80\x85\xa0ªµº»¿ÀÖ×Øö÷øÿĀſƀǅȿɀ̀͏ẞ\u1680\u2000\u200a\u200b\u2028\u202f\u205f\u3000あ東한👍▁")
    common = [*"aetonES .,\n  -12'", "ing", " the", " d'", "é", "ñ"]
    texts = ["".join(rng.choice(common if rng.random() < 0.8 else chars) for _ in range(rng.randrange(1, 40))) for _ in range(6000)]
    texts += [" ", "  ", "\n", "\n\n", " \n", "a\n", "\na", "a ", "a\n b", "a\n\nb", "x" * 23, "x" * 24, "é" * 12, "x" * 70, "." * 30, "1" * 40, " " * 30]
    agree(texts, libraries, alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")))


def test_a_full_table_forgets(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "TABLE_BYTES", 20_000)
    rng = random.Random(2)
    aligner = alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    for _ in range(12):
        texts = [" ".join("".join(rng.choices("abcdeé1.'", k=rng.choice([3, 9, 30, 80]))) for _ in range(8)) for _ in range(20)]
        agree(texts, libraries, aligner)
        assert len(aligner.strings) == len(aligner.table) == len(aligner.begin)
        assert aligner.links.size == aligner.measures[:, 3].sum()
    assert aligner.texts([]) == []


def test_no_documents(spark, no_docs):
    assert alignment.align(no_docs).collect() == []
