import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeline.llm import pii as P


def plain(text):
    """The patterns as they are given."""
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return spans


def ours(text):
    base = P.base_spans(text)
    return [(k, a, b) for k in P.KINDS for a, b in base[k]]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@-+_%19 05()é\n", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert ours(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "a.b@c.de", "1.2.3.4", "256.1.1.1", "+1 (523) 555-1055", "x", ".", "@", "-", " ", "1", "é", "5500-0000-0000-0004", "a@b_c@d.e"]), max_size=12))
def test_base_spans_of_mixtures(parts):
    text = "".join(parts)
    assert ours(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "(at)" * 50_000, ":" * 200_000, "0 " * 100_000, "1-" * 100_000, "abc " * 80_000 + "a (at) b.c"])
def test_linear_on_hostile_texts(text):
    model, thresholds = P.trained()
    base = P.base_spans(text)
    P.further_spans(text, {k: v[:3] for k, v in base.items()}, model, thresholds)


@pytest.mark.parametrize(
    "text, span",
    [
        ("please call (523) 555-1055 now", "(523) 555-1055"),
        ("my phone 523-555-1055.", "523-555-1055"),
        ("mail jane.doe (at) example.com today", "jane.doe (at) example.com"),
        ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ],
)
def test_method_adds_spans(text, span):
    got = P.all_spans(text, *P.trained())[1]
    assert [text[a:b] for _, a, b in got] == [span]


@pytest.mark.parametrize("text", ["on 2024-05-06 at 10:20:30", "order 123456789", "page 12-14", "version 1.2.3", "pi is 3.1415926535", "in 1999-2004", "no digits here (at) all"])
def test_clean_texts_stay_clean(text):
    assert P.all_spans(text, *P.trained())[1] == []


def test_trees_separate_held_back_spans():
    import random

    import numpy as np

    rng = random.Random(99)
    rows = [P._synthetic(rng) for _ in range(1000)]
    model, _ = P.trained()
    p = model.probability(np.array([P.features(t, k, a, b) for t, k, a, b, _ in rows], float))
    assert ((p >= 0.5) == np.array([r[4] for r in rows])).mean() > 0.95


def test_precision_and_recall_in_passages_of_the_corpus(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("aeiourstln", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(300)]
    texts = [f"{t} call +1 (523) 555-{1000 + i} or 4111 1111 1111 1111 {t}" if i % 3 == 0 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", texts[0]])], "doc_id long, text string")
    passages, marked = P.passages_of(docs, 200)
    assert len(passages) == 200 and len(marked) == 101 and all(len(x) <= P.PASSAGE for x in passages + marked)
    assert all(any(x in t for t in texts) or x == "" for x in passages)
    confirmed = [x for m in marked for x in P._confirmed(m)]
    assert len(confirmed) >= 100 and {k for _, k, *_ in confirmed} >= {"phone", "card"}
    _, _, judged = P.trained_and_judged(passages, marked)
    assert all(precision >= 0.97 and recall >= 0.8 for precision, recall in judged.values()), judged


def test_query_and_redaction(spark):
    text = "é a.b@c.de 1.2.3.4 +1 (523) 555-1055, 4111 1111 1111 1111"
    rows = [(1, text, 9, "z"), (1, text, 9, "z"), (2, None, 0, "z"), (3, "", 0, "z"), (None, "x@y.zz", 6, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in P.find(df).collect()}
    want = P.listed(plain(text))
    assert got[1].spans == want and got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[2].spans == got[3].spans == "" and got[None].n_email == 1
    clean = {r.doc_id: r for r in P.redact(df).collect()}
    assert clean[1].text == "é [EMAIL] [IP] [PHONE], [CARD]" and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text is None and P.redact(df).columns == df.columns
    assert P.find(df.limit(0)).count() == 0


def test_many_spans_of_one_text_stay_disjoint():
    model, thresholds = P.trained()
    text = " ".join(f"call 555-{i % 900 + 100}-{i % 9000 + 1000} or a{i}@b.com" for i in range(6000))
    base, spans = P.all_spans(text, model, thresholds)
    assert len(base["email"]) == 6000 and len(spans) == 12000
    ends = sorted((a, b) for _, a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))


def test_merged_spans_answer_overlaps():
    taken = P._merged([(5, 9), (1, 3), (8, 12), (20, 21)])
    assert taken == [(1, 3), (5, 12), (20, 21)]
    plain = lambda a, b: any(s < b and a < e for s, e in taken)
    assert all(P._overlaps(taken, a, b) == plain(a, b) for a in range(25) for b in range(a + 1, 25))


def test_account_and_national_numbers_are_found_by_their_kind():
    from lodeline.llm import pii

    model, thresholds = pii.trained()

    def kinds(text):
        return [(k, text[a:b]) for k, a, b in pii.all_spans(text, model, thresholds)[1]]

    assert kinds("IBAN DE89 3704 0044 0532 0130 00 thanks") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("konto GB82WEST12345698765432, please") == [("iban", "GB82WEST12345698765432")]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00 thanks") == []  # check digits are wrong
    assert kinds("my ssn 123-45-6789 is private") == [("national", "123-45-6789")]
    assert kinds("lot 000-45-6789 and dni 12345678A") == []
    assert kinds("dni 12345678Z") == [("national", "12345678Z")]
