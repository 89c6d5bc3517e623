import random

import pytest

from strandweave import __main__ as cli
from strandweave import mapper

COMPLEMENT = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(11)
    return {n: "".join(rng.choices("ACGT", k=size)) for n, size in (("chrB", 9000), ("chrA", 12000))}


def sampled(genome):
    """Reads of 1,500 bases with one base in 100 changed: (name, contig, begin, reverse, seq)."""
    rng, out = random.Random(12), []
    for i in range(12):
        contig = rng.choice(sorted(genome))
        begin = rng.randrange(len(genome[contig]) - 1500)
        seq = "".join(rng.choice("ACGT") if rng.random() < 0.01 else b for b in genome[contig][begin : begin + 1500])
        out.append((f"r{i}", contig, begin, i % 2 == 1, seq.translate(COMPLEMENT)[::-1] if i % 2 else seq))
    return out


def test_config():
    assert mapper.preset_seeding("lr") == (21, 9) and mapper.preset_seeding("splice") == (15, 10)
    got = mapper.Config("lr:hq", band=700).resolved()
    assert (got.k, got.s, got.band, got.gap) == (21, 5, 700, 5000) and got.resolved() == got
    for bad in (mapper.Config("ava-ont"), mapper.Config("x"), mapper.Config("splice"), mapper.Config(k=9, s=9), mapper.Config(k=32), mapper.Config(downsample=0), mapper.Config(occ_cap=0), mapper.Config(gap=-1)):
        with pytest.raises(ValueError):
            bad.resolved()


def expected(lines, reads, genome):
    rows = [x.split("\t") for x in lines]
    first = {}
    for r in rows:
        first.setdefault(r[0], r)
    for name, contig, begin, reverse, seq in reads:
        r = first[name]
        assert (r[1], r[4], r[5], r[6]) == (str(len(seq)), "-" if reverse else "+", contig, str(len(genome[contig])))
        assert abs(int(r[7]) - begin) < 100 and abs(int(r[8]) - begin - 1500) < 100 and int(r[3]) - int(r[2]) > 1300


@pytest.mark.parametrize("config", [mapper.Config(), mapper.Config("lr:hq", downsample=2, occ_cap=5)])
def test_reads_are_placed_where_they_come_from(spark, genome, config):
    reads = sampled(genome)
    m = mapper.Mapper(spark.createDataFrame([*genome.items(), (None, "ACGT"), ("empty", "")], "name string, seq string"), config)
    rows = [(i, r[0], r[4]) for i, r in enumerate(reads)] + [(90, "lost", "ACGTTGCA" * 40), (91, "empty", ""), (92, "null", None), (None, "no id", "ACGT")]
    got = m.paf(spark.createDataFrame(rows, "id long, name string, seq string")).orderBy("id", "rank").collect()
    expected([r.line for r in got], reads, genome)
    assert [r.line for r in got if r.id >= 90] == [f"{n}\t{s}\t0\t0\t*\t*\t0\t0\t0\t0\t0\t0" for n, s in (("lost", 320), ("empty", 0), ("null", 0))]


def test_empty_references(spark):
    m = mapper.Mapper(spark.createDataFrame([], "name string, seq string"))
    got = m.paf(spark.createDataFrame([(1, "a", "ACGT" * 50)], "id long, name string, seq string")).collect()
    assert [r.line.split("\t")[0] for r in got] == ["a"]


def test_command_line(spark, genome, tmp_path, capsys):
    reads = sampled(genome)
    (tmp_path / "g.fa").write_text("".join(f">{n} x\n{s}\n" for n, s in genome.items()))
    (tmp_path / "r.fq").write_text("".join(f"@{r[0]} c\n{r[4]}\n+\n{'I' * 1500}\n" for r in reads))
    assert cli.main(["align", str(tmp_path / "g.fa"), str(tmp_path / "r.fq"), "-o", str(tmp_path / "out")]) == 0
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    expected(lines, reads, genome)
    assert list(dict.fromkeys(x.split("\t")[0] for x in lines)) == [r[0] for r in reads]
    assert cli.main(["version"]) == 0 and "strandweave" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["align", "a", "b", "-o", "c", "-x", "none"])
