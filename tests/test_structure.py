import pytest
from pyspark.sql import functions as F

from veilspark.operators.structure import count_outside_quotes, signals, split_outside_quotes

ROW = "zib,zab,zob,zub,zeb"
PEOPLE = "name,dob,address,thing"


def doc(n):
    body = "1. First clause here\n\n- a bullet point\n\nSCOPE OF WORK\n\n"
    return body + "plain words " * ((n - len(body)) // 12 + 1)


CASES = [
    ("rows", "\n".join([ROW] * 8), "user_message", [("bulk_data_export", "medium")]),
    ("many rows", "\n".join([ROW] * 30), "user_message", [("bulk_data_export", "high")]),
    ("three rows", "\n".join([ROW] * 3), "user_message", []),
    ("prose", "Well, yes. So, we go on.\nThen, later, we stop.\nNo commas.\nOne, only.\nEnd.", "user_message", []),
    ("quoted", 'a,"b,c",d\ne,"f,g,h",i\nj,"k",l\nm,"n,o",p', "user_message", [("bulk_data_export", "medium")]),
    ("pipes", "a | b | c\n1 | 2 | 3\n4 | 5 | 6\n7 | 8 | 9\n", "tool_result", [("bulk_data_export", "medium")]),
    ("tabs only", "\t\t\t\n\t\t\t\n\t\t\t\n\t\t\t\nx", "tool_result", []),
    ("people", "\n".join([PEOPLE] + ["a,b,c,d"] * 5), "tool_result", [("personal_data_export", "high")]),
    ("many people", "\n".join([PEOPLE] + ["a,b,c,d"] * 11), "tool_result", [("personal_data_export", "critical")]),
    ("two fields", "\n".join(["name,dob,x,y"] + ["a,b,c,d"] * 5), "tool_result", [("bulk_data_export", "medium")]),
    ("document", doc(4000), "user_message", [("document_paste", "medium")]),
    ("long document", doc(12000), "attachment", [("document_paste", "high")]),
    ("log", doc(4000), "tool_result", []),
    ("short", doc(500), "user_message", []),
    ("blob", "word " * 1000, "user_message", []),
]


def test_signals(spark):
    df = spark.createDataFrame([(i, t, k) for i, (_, t, k, _) in enumerate(CASES)], "n int, text string, kind string")
    rows = df.select("n", signals(F.col("text"), F.col("kind")).alias("s")).orderBy("n").collect()
    for (name, _, _, want), row in zip(CASES, rows):
        assert [(s.subtype, s.severity) for s in row.s] == want, name


def test_summaries(spark):
    df = spark.createDataFrame([("\n".join([PEOPLE] + ["a,b,c,d"] * 5),), (doc(4000),)], "text string")
    got = [r.s[0].summary for r in df.select(signals(F.col("text"), F.lit("user_message")).alias("s")).collect()]
    words = len(doc(4000).split())
    assert got == [
        "6 rows x 4 columns naming personal fields (address, dob, name) in a user message",
        f"a structured document of roughly {words:,} words was pasted into a user message",
    ]


def walk(line, delimiter):
    """Cells and separators of a line, one character at a time."""
    cells, quote, n = [""], None, 0
    for c in line:
        if quote:
            if c == quote:
                quote = None
            else:
                cells[-1] += c
        elif c in "\"'":
            quote = c
        elif c == delimiter:
            n += 1
            cells.append("")
        else:
            cells[-1] += c
    return n, cells


def test_quotes_on_random_lines(spark):
    import random

    rng = random.Random(3)
    lines = ["".join(rng.choice("ab,|\"' ") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    rows = df.select(
        "i", count_outside_quotes(F.col("line"), ",").alias("n"),
        split_outside_quotes(F.col("line"), F.lit(",")).alias("cells")).collect()
    for r in rows:
        assert (r.n, list(r.cells)) == walk(lines[r.i], ","), lines[r.i]


@pytest.mark.parametrize("n", [1])
def test_tie_goes_to_the_earlier_delimiter(spark, n):
    text = "a|b|c,d,e\n" * 4
    df = spark.createDataFrame([(text,)], "text string")
    from veilspark.operators.structure import table_shape

    row = df.select(table_shape(F.col("text")).alias("t")).first().t
    assert (row.delimiter, row.rows, row.columns) == ("|", 4, 3)
