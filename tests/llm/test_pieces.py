import random

import public_tokenizers
from common import ODD, docs_frame

from courtside.llm.pieces import SHORT, encode_pieces, encoder_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_against_the_library():
    own = encoder_of(MODEL)
    library, r = own.vocabulary.library, random.Random(1)
    letters = "aeinrst  \n.,1é▁ñß\t\0中\U0001F600<s>"
    texts = [t or "" for t in ODD] + ["</s><unk><0x0A>", " " * 40 + "x", "a" * 3000, "ab" * SHORT, "x" + "▁" * 9, "supercalifragilisticexpialidocious" * 3]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(0, 90))) for _ in range(400)]
    ids = [x.tolist() for x in own.encode(texts)]
    assert ids == library.encode(texts, add_eos=True)
    assert [own.vocabulary.decode(i) for i in ids] == library.decode(ids)


def test_heap_and_rows_agree():
    v, r = encoder_of(MODEL).vocabulary, random.Random(2)
    some = ["".join(r.choice("▁thes nrao") for _ in range(r.randrange(1, SHORT + 4))) for _ in range(500)]
    assert v.merge_all(some) == [v.merge(s) for s in some]


def test_decoding_any_ids():
    v, r = encoder_of(MODEL).vocabulary, random.Random(3)
    for _ in range(300):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(259) for _ in range(r.randrange(0, 12))]
        assert v.decode(ids) == v.library.decode(ids)


def test_forgetting_changes_nothing(monkeypatch):
    from courtside.llm import pieces

    monkeypatch.setattr(pieces, "CACHED", 5)
    own, r = pieces.Encoder(encoder_of(MODEL).vocabulary), random.Random(4)
    texts = [" ".join(r.choice("the cat sat on that mat with hats".split()) for _ in range(9)) for _ in range(30)]
    assert [own.encode([t])[0].tolist() for t in texts] == own.vocabulary.library.encode(texts, add_eos=True)


def test_rows(spark):
    rows = list(enumerate(ODD)) + [(0, "twice"), (None, "no id"), (99, "long " * 300_000)]
    got = encode_pieces(docs_frame(spark, rows, extra=True), MODEL).collect()
    library = encoder_of(MODEL).vocabulary.library
    want = [(i, library.encode(t or "", add_eos=True), t or "") for i, t in rows]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=str) == sorted(want, key=str)
    assert encode_pieces(docs_frame(spark, []), MODEL).count() == 0
