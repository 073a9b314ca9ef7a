"""Spans against plain regular expressions, checksums, and the query's digest."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text):
    out = {"email": [m.span() for m in EMAIL.finditer(text)], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        double = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])]
        if 13 <= len(digits) <= 19 and sum(double) % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(alphabet="aB1.@-+ 2é(%_", max_size=60), st.text(alphabet="0123. -+", max_size=60), st.text(max_size=30)))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_known_spans():
    text = "Mail Jo.E+x@mail.example.org, card 4111 1111 1111 1111 or 4111 1111 1111 1112, from 10.0.0.255 and 10.0.0.256, call +44 (0)20 7946 0958; IBAN GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32."
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)] == [("email", "Jo.E+x@mail.example.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+44 (0)20 7946 0958"), ("iban", "GB82 WEST 1234 5698 7654 32")]


def test_ibans_before_capitals_and_digits():
    spain, belgium, austria = "ES91 2100 0418 4502 0005 1332", "BE68539007547034", "AT61 1904 3002 3457 3201"
    for iban in (spain, belgium, austria):
        for after in ("", " BIC", " EUR", " 7", " 12 X", " ABCD 1234", " Euro"):
            assert [(k, a, b) for k, a, b, _ in pii.spans(f"to {iban}{after}.") if k == "iban"] == [("iban", 3, 3 + len(iban))]
    text = f"XX12 ABCD {spain} {belgium} {austria} EUR"
    assert [text[a:b] for k, a, b, _ in pii.spans(text) if k == "iban"] == [spain, belgium, austria]
    assert pii.spans(f"{spain[:-1]}3 BIC") == [] and pii.spans("AB12 CDEF " * 5_000) == []


def test_context_decides_what_a_checksum_leaves_open():
    assert [k for k, *_ in pii.spans("routing number 021000021")] == ["aba"] and pii.spans("order 021000021") == [] and pii.spans("bank 021000022") == []
    assert [k for k, *_ in pii.spans("my SSN is 219-09-9999")] == ["ssn"] and pii.spans("219-09-9999") == [] and pii.spans("ssn 000-09-9999") == []
    plain, near = (next(s for *_, s in pii.spans(t)) for t in ("at 10.1.1.1", "server address 10.1.1.1"))
    assert near > plain


def test_checksums():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88 3704 0044 0532 0130 00")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kind string, spans int")


def test_long_texts_take_no_longer_in_proportion():
    for text in ("1" * 300_000, "1.1.x" * 60_000, "a" * 300_000 + "@", "a@" * 150_000, "+1" + "(" * 300_000, "A" * 300_000, "é1 " * 100_000):
        assert pii.spans(text) == []


def test_frames(spark):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (2, None), (3, ""), (None, "é é +49 30 1234567"), (4, "x" * 200_000 + " 1.2.3.4")]
    got = pii.find(frame(spark, rows)).collect()
    assert [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in got] == [(1, [("email", 0, 6)]), (1, [("email", 0, 6)]), (2, []), (3, []), (None, [("phone", 4, 18)]), (4, [("ip", 200_001, 200_008)])]
    assert pii.find(frame(spark, [])).collect() == []
    hidden = pii.redact(frame(spark, rows))
    assert hidden.columns == ["doc_id", "text", "kind", "spans"] and [r["text"] for r in hidden.collect()][:5] == ["[email]", "[email]", None, "", "é é [phone]"]


def test_query(spark, folder):
    from sparkweave.llm.queries import QUERIES

    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op5_pii"](spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        found = brute(texts[row["doc_id"]] or "")
        told = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in found[k])
        assert row["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and row["spans"].startswith(told)
        assert [row[f"n_{k}"] for k in pii.BASE] == [len(found[k]) for k in pii.BASE]
