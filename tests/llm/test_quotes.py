from opsight.llm.quotes import as_mail, ordered, parse, reply_threads

A = "First message with words\nand a second line of it"
B = f"Answer to the first one\n\nOn Monday, Ann wrote:\n> First message  with words\n> and a second line of it"
C = (
    "Answer to the answer now\n\nOn Tuesday, Bob wrote:\n> Answer to the first one\n>\n> On Monday, Ann wrote:\n"
    ">> First message with words\n>> and a second line of it"
)
D = "> and a SECOND line of it\nonly this part, I agree"
ROWS = [
    (1, 0, A),
    (1, 1, B),
    (1, 2, C),
    (1, 3, D),
    (1, 4, "> never written anywhere\nno parent"),
    (2, 0, "Hello there everyone"),
    (3, 0, "Hello there everyone"),
    (3, 1, "> Hello there everyone\nhi"),
    (4, 0, "> Hello there everyone\nfrom elsewhere, ambiguous"),
    (5, 0, "> Answer to the first one\nfrom elsewhere, unique"),
    (6, 0, None),
    (6, 1, ""),
    (6, None, "no turn here"),
    (None, 7, "> > deep only\n> no turn here"),
    (7, 0, "same words twice"),
    (7, 1, "same words twice"),
    (7, 2, "> same words twice\nlast one before"),
]


def table(spark, rows):
    from pyspark.sql import functions as F

    data = [(c, t, "user", x) for c, t, x in rows]
    schema = "conv_id long, turn long, role string, text string"
    return spark.createDataFrame(data, schema).withColumns({c: F.lit("x") for c in ("root", "_key", "depth")})


def test_parse():
    own, runs = parse(C)
    assert "\n".join(own).strip() == "Answer to the answer now"
    assert [(n, [x for x in lines if x]) for n, lines in runs] == [
        (1, ["Answer to the first one"]),
        (2, ["First message with words", "and a second line of it"]),
    ]
    assert parse("") == ([""], [])
    assert parse("a wrote: b\nc") == (["a wrote: b", "c"], [])


def test_links_and_order(spark):
    got = {r["message"]: r for r in reply_threads(table(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    parent = {k: r["parent"] for k, r in got.items() if r["parent"]}
    assert parent == {"1:1": "1:0", "1:2": "1:1", "1:3": "1:0", "3:1": "3:0", "5:0": "1:1", ":7": "6:", "7:2": "7:1"}
    assert (got["1:2"]["root"], got["1:2"]["depth"]) == ("1:0", 2)
    assert (got["5:0"]["root"], got["5:0"]["depth"]) == ("1:0", 2)
    assert got["1:3"]["text"] == "only this part, I agree"
    assert got["1:1"]["text"] == "Answer to the first one"
    assert got["6:0"]["text"] == got["6:1"]["text"] == ""


def test_long_chain(spark):
    rows = [(1, i, f"Reply number {i} of all\n> Reply number {i - 1} of all") for i in range(70)]
    got = ordered(reply_threads(table(spark, rows))).collect()
    assert [(r["root"], r["depth"]) for r in got] == [("1:0", i) for i in range(70)]


def test_mails_of_conversations_are_linked_back(spark):
    turns = [(c, t, f"Turn {t} of talk {c}\nwith more than one line") for c in range(20) for t in range(4)]
    turns += [(30, 0, "a common opening line"), (31, 0, "a common opening line"), (31, 1, "answer to the opening"), (32, 1, None), (32, 2, "x")]
    got = {r["message"]: r for r in reply_threads(as_mail(table(spark, turns))).collect()}
    texts = {f"{c}:{t}": x for c, t, x in turns}
    for key, row in got.items():
        c, t = map(int, key.split(":"))
        before = f"{c}:{t - 1}"
        assert row["parent"] == (before if texts.get(before) else None)
        assert row["text"] == (texts[key] or "")
    assert reply_threads(as_mail(table(spark, []))).count() == 0


def test_turns_without_a_role_are_quoted_too(spark):
    rows = [(1, 0, None, "What nobody said first"), (1, 1, "user", "An answer to that"), (1, 2, None, "And one more")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["message"]: (r["parent"], r["text"]) for r in reply_threads(as_mail(turns)).collect()}
    assert got == {"1:0": (None, rows[0][3]), "1:1": ("1:0", rows[1][3]), "1:2": ("1:1", rows[2][3])}


def test_empty_tables(spark):
    assert reply_threads(table(spark, [])).count() == 0
    assert ordered(reply_threads(table(spark, []))).count() == 0
