from collections import defaultdict

from tivlens.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, row string, parts string, keeper string"


def brute(rows, least=10, docs=2):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= least:
                held[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < least or len(held[key(x)]) < docs or min(held[key(x)]) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


ROWS = [
    (3, "Shared line one\nown\nSHARED LINE ONE \nÀ distinct LINE here"), (1, "  shared line one\t\n\nshort\nshort"),
    (2, "shared line one"), (2, "shared line one"), (2, "another version\nshared line one\nanother version"), (5, None), (6, ""),
    (None, "shared line one\nx"), (7, "short\n\u00a0shared line one\n" + "word " * 50000), (8, "à distinct line here\nÀ distinct line here"),
]


def order(rows):
    return sorted(rows, key=repr)


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(d, t, "r", "p", "k") for d, t in ROWS], SCHEMA)
    got = dedup_lines(df, carry=True).collect()
    assert order((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got) == order(brute(ROWS))
    assert {tuple(r.row)[1:] for r in got} == {("r", "p", "k")}


def test_threshold_and_empty_table(spark):
    df = spark.createDataFrame([(d, t, "", "", "") for d, t in ROWS], SCHEMA)
    got = dedup_lines(df, min_docs=3).collect()
    assert order((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got) == order(brute(ROWS, docs=3))
    assert dedup_lines(df.limit(0)).count() == 0
