from compare import DATA, same

from tidewatch.llm import linededup

from .conftest import LINES


def test_matches_sql(spark):
    sf = str(DATA / "sf0.01")
    same(linededup.op2(spark.read.parquet(f"{sf}/documents.parquet")), linededup.ORACLE, sf)


def by_hand(rows):
    """Text after removal, by (id, text) in order."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: r[0]):
        lines = text.split("\n")
        real = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for k in range(len(real) - 2):
            w = tuple(lines[i].strip(" ") for i in real[k : k + 3])
            gone |= {real[k], real[k + 1], real[k + 2]} if w in seen else set()
            seen.add(w)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_windows_by_hand(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, "a\n\n b \nc\nd\ne"), (5, "q\nq\nq\nq\nq"), (6, "")]
    got = {r["doc_id"]: r["text"] for r in linededup.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_hand(rows)
    assert got[2] == "x\ny" and got[4] == "\ne" and got[5] == "q"


def test_odd_rows(odd, clashing, nothing):
    rows = linededup.op2(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[3]["text"] is None and by[3]["n_lines"] == 0
    assert by[4]["text"] == "" and by[7]["text"] == LINES and by[7]["n_removed"] == 0
    assert by[8]["text"] == "intro" and by[8]["n_removed"] == 4
    out = linededup.dedup_lines(clashing)
    assert set(clashing.columns) <= set(out.columns) and out.count() == len(rows)
    assert all(r["size"] == "kept size" and r["starts__"] == "kept starts__" for r in out.collect())
    assert linededup.op2(nothing).count() == 0


def test_many_copies_of_one_window(spark):
    rows = [(i, f"own {i}\ncommon one\ncommon two\ncommon three\nend {i}") for i in range(500)]
    got = {r["doc_id"]: r for r in linededup.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["text"] == f"own {i}\nend {i}" for i in range(1, 500))
