import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hawkgrid.llm import alignment
from hawkgrid.llm.queries import op12_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
BACK = alignment.byte_alphabet()
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n  x \t y  ", "don't Don'T 's", "<|endoftext|> x<|endoftext|>", "日本語のテキスト。 次",
    "x▁y z", "é é ñandú", "a\xa0 b \xa0c", "a\x1c b\x85 c", "\U0001F600\U0001F600 ok", "\x00 nul", "1234567 12 3", "tab\tend \t", "</s> <s> <0x41> <unk>",
    "! ! !!  !!!", "a" * 3_000, " " * 500 + "b" + "\n" * 300, "été" * 2_000, "word and more " * 500,
]


def tokens(text):
    """(id, bytes) of both, or None where bytes are not given back."""
    if not text:
        return None
    vocab = tokens.vocab
    a = [(i, bytes(BACK[c] for c in vocab[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes((int(p[3:5], 16),)) if B.is_byte(i) else p.replace("▁", " ").encode())
         for i, p in ((i, B.id_to_piece(i)) for i in B.encode(text))]
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None


tokens.vocab = {i: t for t, i in A.get_vocab(with_added_tokens=False).items()}


def groups_of(text):
    both = tokens(text)
    if both is None:
        return None
    ends = []
    for side in both:
        at, found = 0, []
        for i, raw in side:
            at += len(raw)
            found.append((at, i))
        ends.append(found)
    cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    out, low = [], 0
    for cut in cuts:
        out.append(tuple([i for e, i in side if low < e <= cut] for side in ends))
        low = cut
    return out


def brute(rows):
    held = {t: groups_of(t) for t in {t for _, t in rows}}
    links = {t: Counter((a, b) for x, y in g for a in x for b in y) for t, g in held.items() if g}
    counts = Counter()
    for _, text in rows:
        counts.update(links.get(text, {}).keys())
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for doc_id, text in rows:
        g = held[text]
        if not g:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links[text].values()),
            sum(n for p, n in links[text].items() if counts[p] == top[p[0]]), sum(n * counts[p] for p, n in links[text].items()),
            hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in alignment.align(df, A_PATH, B_PATH, **kw).collect()), key=repr)


def test_odd_texts_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None, *ODD[5:12]])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("narrow", [0, 4096])
def test_small_blocks_and_wide_units(spark, monkeypatch, narrow):
    rng = random.Random(3)
    words = ["alpha", "Beta,", "gamma.", "ñandú", "x1", "--", "\n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += rows[:3] + [(None, "alpha"), (None, None)] + [(500 + i, "hot text") for i in range(40)]
    al = alignment.Aligner(A_PATH, B_PATH)
    monkeypatch.setattr(alignment, "_NARROW", narrow)
    block = alignment._Block()
    texts = sorted({t for _, t in rows if t})
    for text in texts:
        block.add(al, [text.encode()], [1])
    row = block.row(0)
    expected = Counter(p for t in texts for p in {(a, b) for x, y in groups_of(t) or () for a in x for b in y})
    pairs = zip(row.column("pairs")[0].as_py(), row.column("holds")[0].as_py())
    assert {divmod(p, al.width): n for p, n in pairs} == expected
    assert run(spark, rows, block_bytes=200) == brute(rows)


def test_wide_and_narrow_units_give_the_same(monkeypatch):
    for text in ODD:
        found = []
        for limit in (0, 10**9) if text else ():
            monkeypatch.setattr(alignment, "_NARROW", limit)
            block = alignment._Block()
            block.add(_fresh(), [text.encode()], [2])
            found.append(block.row(0).to_pydict() if block.n else None)
        assert not text or found[0] == found[1]


def _fresh():
    al = _fresh.aligner = getattr(_fresh, "aligner", None) or alignment.Aligner(A_PATH, B_PATH)
    al._clear()
    return al


def test_store_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(alignment, "_MAX_UNITS", 50)
    al = alignment.Aligner(A_PATH, B_PATH)
    for low in range(0, 400, 20):
        units = ["common", "often", *[f"w{k}" for k in range(low, low + 20)]]
        al.places([units, ["common", "often"]])
        places = al.places([units])
        facts = al.facts[places]
        for unit, fact in zip(units, facts.tolist()):
            g = groups_of(unit)
            assert fact[:4] == [sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(len(x) * len(y) for x, y in g)]
            codes = al.codes[fact[4]:fact[4] + fact[5]].tolist()
            assert codes == [a * al.width + b for x, y in g for a in x for b in y]
    assert len(al.groups) < 100 and "common" in al.place


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbsS' \n\t\x0b\xa0\x85 \x1c.,!1é́日"), min_size=1, max_size=25))
def test_units_equal_whole_texts(text):
    al = _fresh()
    units = al.split(text)
    assert "".join(" " + u for u in units) == " " + text
    whole = [e.ids for e in A.encode_batch([" " + u for u in units], add_special_tokens=False)]
    assert sum(whole, []) == A.encode(" " + text, add_special_tokens=False).ids
    assert al.a.encode([" " + text])[0] == A.encode(" " + text, add_special_tokens=False).ids
    assert sum(al.b.encode([" " + u for u in units]), []) == B.encode(text)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string").select(
        "*", *[F.lit(9).alias(c) for c in ("copies", "digest", "block", "pairs", "n_a")])
    assert sorted(tuple(r) for r in alignment.align(df, A_PATH, B_PATH).collect()) == brute([(1, "a b"), (1, "a b")])
    assert alignment.align(df.limit(0), A_PATH, B_PATH).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op12_alignment(spark, sf).collect()), key=repr) == brute(rows)
