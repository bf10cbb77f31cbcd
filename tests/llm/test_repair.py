import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.queries.repair_query import SQL, op11_conversation_repair
from tallyspark.llm.repair import CLOSING, cheapest, digest_lines, read_edits, repair_conversations, solve

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def enumerated(rows, most_new=3):
    """The cheapest edits by trying all: each row kept, given a role or deleted, with up to ``most_new`` rows put in before it and at the end."""
    options = [[("D", "", 3)] if gone else [("K", initial, broken), ("R", "u", 2 + broken), ("R", "a", 2 + broken), ("D", "", 3)] for initial, gone, broken, _ in rows]
    puts = [p for p in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1) if sum(map(len, p)) <= most_new]
    best = None
    for pick in itertools.product(*options):
        for put in puts:
            roles = "".join(n + p[1] for n, p in zip(put, pick)) + put[-1]
            if re.fullmatch("(s?(ua)+)?", roles):
                found = (sum(p[2] for p in pick) + 2 * sum(map(len, put)), "".join("I" * len(n) + p[0] for n, p in zip(put, pick)) + "I" * len(put[-1]), roles)
                best = min(best or found, found)
    return best


def test_equals_trying_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3, 0) for _ in range(rng.randint(1, 3))]
        cut = rng.randint(0, len(rows))
        got = cheapest([solve(part) for part in (rows[:cut], rows[cut:]) if part])
        cost, letters, roles = enumerated(rows)
        assert (got.cost, got.letters) == (cost, letters), rows
        assert got == cheapest([solve(rows, (0,))]) or got.letters == cheapest([solve(rows, (0,))]).letters
        edits = read_edits(letters, [r[0] for r in rows], [0] * len(rows))
        written = "".join({"u": "u", "a": "a", "U": "u", "A": "a", "=": r[0], "-": ""}[c] for e, r in zip(edits, rows) for c in e)
        assert written == roles


def test_pieces_join_to_the_whole():
    rng = random.Random(4)
    rows = [(rng.choice("suua"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([0, 0, 0, 2])) for _ in range(300)]
    whole = cheapest([solve(rows)])
    for size in (1, 7, 64):
        got = cheapest([solve(rows[k : k + size]) for k in range(0, len(rows), size)])
        assert (got.cost, got.letters) == (whole.cost, whole.letters)
    assert CLOSING[1, 3].letters == "II"


@pytest.fixture(scope="module")
def odd_chats(spark, tmp_path_factory):
    """Null ids, turns, roles and texts, equal turns, repeats, a conversation of more than a chunk, foreign roles, further columns."""
    rng = random.Random(5)
    words = ["Yes.", "No", " ", "", None, "\t\n", "Is it?", "Well . ", "Ünï!", "line\nbreak", "a" * 50_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ursula"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(words)) for c in [*range(60), None] for t in range(rng.randint(1, 9))]
    rows += [(-3, t, ("user", "assistant")[t % 2], f"Turn {t}" + ("." if t % 5 else "")) for t in range(1500)]
    rows += [(-4, 7, "user", "Again.")] * 40 + [(-5, 10**12, "user", "Far."), (-5, -5, "assistant", "Away.")]
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, at int, `key` string").repartition(5).write.parquet(f"{d}/conversations.parquet")
    return d


def test_odd_rows_equal_sql(spark, odd_chats):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{odd_chats}/conversations.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({SQL})").fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in op11_conversation_repair(spark, odd_chats).select(*COLUMNS).collect()), key=repr)
    assert got == want


def test_repaired_rows_read_as_they_should(spark, odd_chats):
    done = repair_conversations(spark.read.parquet(f"{odd_chats}/conversations.parquet"))
    lines = done.rows.select("conv_id", "at", F.posexplode("lines").alias("i", "x")).select("conv_id", "at", "i", "x.role", "x.text").collect()
    chats = {}
    for r in sorted(lines, key=lambda r: (r.at, r.i)):
        chats.setdefault(r.conv_id, []).append(r)
    for rows in chats.values():
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in rows))
    sha = {r.conv_id: r.sha256 for r in digest_lines(done.rows).collect()}
    assert all(sha[c] == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows).encode()).hexdigest() for c, rows in chats.items())


def test_empty_table(spark, odd_chats):
    done = repair_conversations(spark.read.parquet(f"{odd_chats}/conversations.parquet").limit(0))
    assert done.report.count() == 0 and done.rows.count() == 0 and digest_lines(done.rows).count() == 0
