"""Boilerplate by site spread against a plain count; odd rows."""

from collections import defaultdict

from riskfuse.llm import line_spread as L

SCHEMA = "doc_id long, text string, source string, n_chars long, line string, first int"


def plain(rows, min_sites):
    sites, first = defaultdict(set), {}
    for doc_id, text, source, *_ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\r")
            if key:
                sites[key].add(source or "")
                if doc_id is not None:
                    first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [len(sites[x.strip(" \t\r")]) >= min_sites and first.get(x.strip(" \t\r")) not in (None, doc_id) for x in lines]
        out.append((doc_id, None if text is None else "\n".join(x for x, g in zip(lines, gone) if not g), sum(gone)))
    return out


def corpus():
    rows = []
    for k in range(400):
        lines = [f"own line {k}", "", f"seen by {k % 40} sites or so" if k % 3 else "  ", f"  wide {k % 4}\t", f"line {k % 130}"]
        rows.append((k, "\n".join(lines), f"site{k % (60 if k % 2 else 7)}", 3, "c", 1))
    many = "\n".join(f"long document's line {k}" for k in range(20_000))
    rows += [(900, None, "a", 0, "c", 1), (901, "", None, 0, "c", 1), (902, "   ", "a", 0, "c", 1), (903, "wide 1", None, 0, None, None), (903, "wide 1", None, 0, None, None),
             (904, many, "m", 0, "c", 1), (None, "wide 2\nown", "n", 0, "c", 1), (905, "wide 2\r\n\nwide 3", "site1", 0, "c", 1)]
    return rows


def test_against_plain_count(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for min_sites in (2, 10, 33):
        got = sorted(((r.doc_id, r.text, r.n_removed) for r in L.cleaned(docs, min_sites).collect()), key=str)
        assert got == sorted(plain(rows, min_sites), key=str)
    assert L.cleaned(docs.limit(0)).count() == 0


def test_near_lines_are_counted_exactly(spark):
    """Spreads all around the limit, where a sketch of 1024 registers errs."""
    rows = [(s * 1000 + k, f"spread {k}", f"s{s}", 0, "", 0) for k in range(80, 120) for s in range(k)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = L.boilerplate(L.occurrences(docs), 100)
    assert found.count() == 20 and {r["first"] for r in found.collect()} == set(range(100, 120))


def test_stage_keeps_columns_and_drops_what_is_all_boilerplate(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = L.without_boilerplate(docs, 2)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(i, t) for (i, t, n) in plain(rows, 2) if not n or t.replace("\n", "").strip(" \t\r")]
    assert got == sorted(want, key=str) and len(got) < len(rows)
    before = {r[0]: r[1] for r in rows}
    for r in out.collect():
        if r.doc_id is not None and r.text is not None:
            assert r.n_chars == (len(r.text) if r.text != before[r.doc_id] else (3 if r.doc_id < 900 else 0))


def test_long_lines_have_a_lower_limit(spark):
    """Few sites: long lines go from the second site on, short ones and those of a single site stay."""
    long = [" ".join(f"w{n}x{k}" for k in range(51)) for n in range(3)]
    at_limit = " ".join(f"at{k}" for k in range(50))
    rows = [(1, f"{long[0]}\none", "a", 0, "", 0), (2, f" {long[0]}\t\ntwo\n{long[1]}", "b", 0, "", 0), (3, f"{long[1]}\nshort\n{at_limit}", "b", 0, "", 0),
            (4, f"short\n{at_limit}\n{long[2]}", "a", 0, "", 0), (5, long[2], None, 0, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text for r in L.without_boilerplate(docs, 10, long_sites=2).collect()}
    assert got == {1: rows[0][1], 2: f"two\n{long[1]}", 3: rows[2][1], 4: rows[3][1]}
    assert all(r.n_removed == 0 for r in L.cleaned(docs).collect())
