"""Multi-line CSV from many splits: the rows of the one-task reader at every block size."""
import random

import pytest

from bitextkit import sources as SRC
from bitextkit.sources import csv_blocks


@pytest.fixture
def block(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield use
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def cell(rnd):
    x = "".join(rnd.choice(["a", "b ", "é", "\U0001f600", ",", '"', "\n", "\n\n", "x,y", '""', " "]) for _ in range(rnd.randrange(0, 9)))
    if any(c in x for c in ',"\n') or rnd.random() < 0.3:
        return '"' + x.replace('"', '""') + '"'
    return x.strip() or "plain"


def make(seed, n=60):
    rnd = random.Random(seed)
    rows = ["src,tgt"]
    for _ in range(n):
        k = rnd.choice([2, 2, 2, 2, 1, 3])                 # short and long rows too
        rows.append(",".join(cell(rnd) for _ in range(k)))
        if rnd.random() < 0.1:
            rows.append("")                                # a blank line
    return "\n".join(rows) + "\n"


def rows(df):
    return sorted(((r.src is None, r.src or "", r.tgt is None, r.tgt or "") for r in df.collect()))


@pytest.mark.parametrize("size", [23, 64, 301, 1 << 20])
def test_same_rows_as_one_task(spark, tmp_path, block, size):
    for seed in range(2):
        (tmp_path / f"p{seed}.csv").write_text(make(seed), encoding="utf-8")
    want = rows(SRC.read_parallel_csv(spark, str(tmp_path), na_values=(), multi_line=True))
    block(size)
    assert rows(SRC.read_parallel_csv(spark, str(tmp_path), na_values=(), multi_line="split")) == want and len(want) > 60


def test_maps_of_lines(spark):
    def ends(line, inside):
        field_start, i = not inside, 0
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        inside = False
            elif c == ",":
                field_start = True
                i += 1
                continue
            elif c == '"' and field_start:
                inside = True
            field_start = False
            i += 1
        return int(inside)
    rnd = random.Random(3)
    lines = ["".join(rnd.choice('"",ab ') for _ in range(rnd.randrange(0, 9))) for _ in range(3000)]
    d = spark.createDataFrame([(x,) for x in sorted(set(lines))], "t string")
    for r in d.selectExpr("t", f"t rlike r'{csv_blocks.ENDS_INSIDE}' AS o", f"t rlike r'{csv_blocks.STAYS_INSIDE}' AS i").collect():
        assert (int(r.o), int(r.i)) == (ends(r.t, False), ends(r.t, True)), r.t


def test_quality_counts_one_header_a_file(spark, tmp_path, block):
    (tmp_path / "a.csv").write_text('src,tgt\na,b\nc,"d\ne"\nx,y,z\n')
    (tmp_path / "b.csv").write_text("src,tgt\nf,g\n")
    (tmp_path / "c.csv").write_text("src,tgt\n")
    block(9)
    q = SRC.csv_quality(spark, str(tmp_path)).first()
    assert (q.raw_lines, q.parsed, q.malformed) == (5, 3, 2)
    with pytest.raises(ValueError):
        SRC.read_parallel_csv(spark, str(tmp_path), tolerant=False, multi_line="split")
