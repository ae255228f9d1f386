"""Exact dedup and personal data against plain versions."""

from __future__ import annotations

import brute
import pytest

from tallywind.llm import exact_dedup, pii


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("fan_in", [2, 8])
@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_exact_groups(request, plain, which, fan_in):
    df = request.getfixturevalue(which)
    rows = exact_dedup.exact_groups(df, fan_in).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == ordered(brute.exact_groups(plain(df)))
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_drop_copies(request, which):
    df = request.getfixturevalue(which)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r.text_sha256 for r in exact_dedup.exact_groups(df).collect()})


@pytest.mark.parametrize("which", ["docs", "odd_docs", "no_docs"])
def test_pii(request, plain, which):
    df = request.getfixturevalue(which)
    got = ordered((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_report(df).collect())
    assert got == ordered((d, *brute.personal(t)[0], brute.personal(t)[1]) for d, t in plain(df))


def test_iban_and_context(odd_docs):
    rows = {r.doc_id: r for r in pii.pii_report(odd_docs.filter("doc_id in (23, 24)")).collect()}
    assert rows[24].n_iban == 1 and rows[24].spans == "iban:5:32" and rows[24].best_score == pytest.approx(1.0)
    assert rows[23].spans.split(",")[0] == "email:6:25" and "card" in rows[23].spans


def test_native_plans(odd_docs):
    for df in (pii.pii_report(odd_docs), exact_dedup.exact_groups(odd_docs)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in text for word in ("Python", "Arrow", "Pandas"))
