from pyspark.sql import types as T

from tracewright.llm import chat

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("block", T.StringType())])


def brute(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None and t is not None:
            convs.setdefault(c, set()).add((t, r or "", x or ""))
    lists = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in convs.items()}
    keep = {}
    for c in sorted(lists):
        mine = lists[c]
        if any(len(o) > len(mine) and o[: len(mine)] == mine for o in lists.values()):
            continue
        if any(o == mine and k < c for k, o in lists.items()):
            continue
        keep[c] = "".join(f"<|{r}|>\n{x}\n" for r, x in mine)
    return keep


def test_collapse(spark):
    rows = []
    for c, turns in enumerate([["a"], ["a", "b"], ["a", "b", "c"], ["a", "c"], ["a", "b", "c"], ["b"], ["b", "a"], [None, ""]]):
        rows += [(c, 10 * c + t, "user" if t % 2 == 0 else None, x, "q") for t, x in enumerate(turns)]
    rows += [(None, 1, "user", "a", "q"), (3, None, "user", "zz", "q"), rows[0], rows[1]]
    long = [(50, t, "user", f"t{t}", "q") for t in range(1300)]
    rows += long + [(51, *r[1:]) for r in long[:900]] + [(52, *r[1:]) for r in long]
    got = {}
    for r in sorted(chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.conv_id, r.segment)):
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
    assert got == brute(rows)


def test_tables_and_empty(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r.conv_id: r.text for r in chat.format_chats(table).collect()}
    assert got == brute([tuple(r) for r in table.collect()])
    assert chat.format_chats(table.limit(0)).count() == 0
