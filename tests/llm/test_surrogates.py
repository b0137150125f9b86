"""Surrogates where there are more entities than a first draw has values."""

from quillspan.llm import common, surrogates


def test_more_entities_than_first_values(spark, monkeypatch):
    """9,000 names of one word have 8,000 first surrogates, 26 one-letter mails at one domain have 16."""
    written, made = common.written, []

    def counted(df, what):
        made.append(what)
        assert len(made) < 25, "drawn again without end"
        return written(df, what)

    monkeypatch.setattr(common, "written", counted)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"Q{a}{b}{c}" for a in letters for b in letters for c in letters][:9000]
    rows = [("name", n, f"Mr {n}") for n in names] + [("mail", f"{c}@mail.example.com", f"{c}@mail.example.com") for c in letters] + [("mail", f"_@{c}.com", f"_@{c}.com") for c in letters]
    got = surrogates.dictionary(spark.createDataFrame(rows, "kind string, norm string, sample string"), "key").collect()
    drawn = {(r["kind"], r["drawn"]) for r in got}
    assert len(got) == len(rows) and len(drawn) == len(rows)
    assert not drawn & {(k, n) for k, n, _ in rows}
    assert all(d.istitle() and d.endswith(surrogates.SYLLABLES["latin"][2]) for k, d in drawn if k == "name")
    assert all(d.endswith(".com") and d.count("@") == 1 for k, d in drawn if k == "mail")
