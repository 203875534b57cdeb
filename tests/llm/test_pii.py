"""PII: patterns against plain regular expressions, disclosure against a recount."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthline.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for k, pattern, good in ((2, CARD, lambda d: 14 <= len(d) <= 19 and luhn(d)), (3, PHONE, lambda d: 10 <= len(d) <= 15)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if good(re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text("a.@-1250+ ()%é\n", max_size=40))
def test_patterns(text):
    assert [s[:3] for s in pii.pattern_spans(text)] == plain(text)


def test_patterns_by_hand():
    text = "x a@b.c@d.e ü 4111 1111-1111 1111 +1 (555) 010-9999 or 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8 é@x.y 3163220311217393"
    assert [s[:3] for s in pii.pattern_spans(text)] == plain(text)
    assert Counter(k for _, k, _ in plain(text)) == {0: 1, 1: 3, 2: 2, 3: 1}
    for long in ("1" * 200_000, "1.1.1.256." * 30_000, "y" * 200_000 + "@", "+1" + "(" * 200_000, "a@" * 100_000, "1 " * 100_000):
        assert pii.pattern_spans(long) == []  # in no more than linear time


TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def begun(term):
    return term[: pii.BEGINNING].decode(errors="ignore").encode() if len(term) > pii.BEGINNING else term


def terms_of(text):
    """(term, start, stop) in code points; bytes of a term lower-cased."""
    raw = text.encode()
    return [(m[0].lower(), len(raw[: m.start()].decode()), len(raw[: m.end()].decode())) for m in TERM.finditer(raw) if m.end() - m.start() >= pii.SHORTEST]


def added(texts, window=pii.WINDOW, least=pii.DISCLOSURE):
    """The spans that co-occurrence adds to each text."""
    n_entity, n_term, n_begin, both, both_begin, kinds = Counter(), Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    near = []
    for text in texts:
        spans = pii.pattern_spans(text)
        terms = terms_of(text)
        n_entity.update({(k, value) for _, k, _, value in spans})
        n_term.update({t for t, *_ in terms})
        n_begin.update({begun(t) for t, *_ in terms})
        free = [t for t in terms if not any(a < t[2] and t[1] < b for a, _, b, _ in spans)]
        mine = []
        for a, k, b, value in spans:
            left, right = [t for t in free if t[2] <= a][-window:], [t for t in free if t[1] >= b][:window]
            mine += [((k, value), *t) for t in left + right]
        both.update({(e, t) for e, t, *_ in mine})
        both_begin.update({(e, begun(t)) for e, t, *_ in mine})
        for e, t, *_ in mine:
            kinds[e, t].add(text)
        near.append(mine)

    def share(together, term, entity):
        if entity == len(texts):
            return -1
        return math.log(len(texts) * together / (entity * term)) / math.log(len(texts) / entity)

    out = []
    for mine in near:
        found = {}
        for e, t, a, b in mine:
            if len(kinds[e, t]) > 1 and share(both[e, t], n_term[t], n_entity[e]) >= least:
                still = share(both_begin[e, begun(t)], n_begin[begun(t)], n_entity[e]) >= least
                found[a, 4, b] = max(found.get((a, 4, b), ""), "remove" if still else "generalise")
        out.append([(*k, v) for k, v in found.items()])
    return out


def wanted(rows):
    texts = [r.text or "" for r in rows]
    return sorted((repr(r.doc_id), sorted([*((*s, "replace") for s in plain(t)), *more])) for r, t, more in zip(rows, texts, added(texts)))


def got(df):
    return sorted((repr(r.doc_id), [tuple(s) for s in r.hl_spans]) for r in df.collect())


STORY = [
    "Call Zoltan Kerekes at zk@mail.example or +36 1 555 0100 about the boat house",
    "the boat by Zoltan Kerekes, zk@mail.example, is for sale in the harbour",
    "a boat house for sale in the harbour, ask the house office",
    "kernel boats in the harbour are for sale by the office",
    "the office is open",
    "4111111111111111 paid by office desk",
]


def test_terms_that_reveal(spark):
    rows = [(i, t) for i, t in enumerate(STORY + ["nothing of note in here"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.sanitise(docs, ["doc_id"], with_text=True).collect()}
    names = {(r.doc_id, rows[r.doc_id][1][s.start : s.stop], s.action) for r in out.values() for s in r.hl_spans if s.kind == pii.TERM}
    assert names == {(i, *x) for i in (0, 1) for x in (("Zoltan", "remove"), ("Kerekes", "remove"), ("boat", "generalise"))}
    assert out[0].hl_text == "Call … … at [EMAIL] or [PHONE] about the boat… house" and out[2].hl_text is None
    assert wanted(docs.collect()) == got(pii.sanitise(docs, ["doc_id"]))


def test_a_term_goes_wherever_it_stands_in_the_text(spark):
    """Also further from the entity than the terms that are looked at, but not in texts without the entity."""
    far = "Zoltan met " + "many people by the sea " * 4 + "and kept zk@mail.example with Zoltan, " + "some more of it and then " * 3 + "zoltan left"
    texts = [far, "ask Zoltan, zk@mail.example", "Zoltan without"] + [f"nothing of note, people by the sea and some more of it then met {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.sanitise(docs, ["doc_id"], with_text=True).collect()}
    assert [far[s.start : s.stop] for s in out[0].hl_spans if s.kind == pii.TERM and far[s.start : s.stop].lower() == "zoltan"] == ["Zoltan", "Zoltan", "zoltan"]
    assert "zoltan" not in out[0].hl_text.lower() and out[0].hl_text.count("[EMAIL]") == 1 and "many people by the sea" in out[0].hl_text
    assert out[2].hl_text is None and not out[2].hl_spans


def test_a_term_goes_beside_an_entity_that_it_does_not_reveal(spark):
    """Zoltan reveals the address, which the texts with the number do not all have; in a text with both he goes beside either."""
    both = "Zoltan at zk@mail.example" + ", and so on" * 8 + ", says Zoltan on +36 1 555 0100"
    texts = [both, "ask Zoltan, zk@mail.example"] + [f"line {i} is +36 1 555 0100 here" for i in range(20)] + [f"nothing of note and so on {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.sanitise(docs, ["doc_id"]).where("doc_id = 0").first().hl_spans
    assert [both[s.start : s.stop] for s in spans if s.kind == pii.TERM and both[s.start : s.stop] == "Zoltan"] == ["Zoltan", "Zoltan"]


def test_a_common_beginning_discloses_less(spark):
    rows = [(i, f"{w} ann@x.org") for i, w in enumerate(["kerekes one", "kerekes two"])]
    rows += [(10 + i, f"the kere{w} story") for i, w in enumerate("bcdfghjklm" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.sanitise(docs, ["doc_id"], with_text=True).where("doc_id < 2").orderBy("doc_id").collect()
    assert [r.hl_text for r in out] == ["kere… one [EMAIL]", "kere… two [EMAIL]"]
    assert got(pii.sanitise(docs, ["doc_id"])) == wanted(docs.collect())


def test_one_text_in_many_copies_is_no_link(spark):
    docs = spark.createDataFrame([(i, "Zoltan zk@mail.example") for i in range(50)] + [(99, "else")], "doc_id long, text string")
    assert all(s.kind == 0 for r in pii.sanitise(docs, ["doc_id"]).collect() for s in r.hl_spans)


def test_odd_documents(spark, odd_documents, no_documents):
    assert got(pii.sanitise(odd_documents, ["doc_id"])) == wanted(odd_documents.collect())
    texts = [*STORY, *STORY[:2], "Łukasz" + " zk@mail.example é" * 3, "a@b.cc" * 4, "+1 (555) 010-9999" * 50, None, "", "0" * 3_000]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], no_documents.schema)
    assert got(pii.sanitise(docs, ["doc_id"])) == wanted(docs.collect())
    clash = odd_documents.withColumnRenamed("key", "hl_added_to")
    assert pii.sanitise(clash, clash.columns).count() == clash.count()
    assert pii.sanitise(no_documents, ["doc_id"]).count() == 0


def by_contract(docs):
    names, out = [*pii.KINDS, "term"], []
    for doc_id, spans in wanted(docs):
        lists = [",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in s) for s in ([x for x in spans if x[1] < 4], spans)]
        counts = Counter(k for _, k, _, _ in spans)
        out.append((doc_id, *(counts[k] for k in range(4)), sha256(lists[0].encode()).hexdigest(), lists[1]))
    return sorted(out)


def columns_of(rows):
    return sorted((repr(r[0]), *r[1:]) for r in rows)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op11_pii_sanitisation(spark, folder).collect()
    assert columns_of(rows) == by_contract(spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert sum(r.n_email for r in rows) > 0


@pytest.mark.parametrize("limit", ["1000000", "3"])
def test_query_where_terms_reveal(spark, no_documents, tmp_path, limit):
    """With and without hot keys."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(STORY * 3 + ["nothing of note"] * 40 + [STORY[1] + " now"] * 5)], no_documents.schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.hearthline.hotRows", limit)
    rows = queries.op11_pii_sanitisation(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.hearthline.hotRows")
    assert columns_of(rows) == by_contract(docs.collect()) and any("term:" in r.spans for r in rows)
