"""Local alignments and aligned tags against plain matrices, planted variants at loci, and SAM lines against edits that made them."""

import random

from allelix.operators import loci
from allelix.sources.alignments import read_sam


def plain_local(a, b, match=2, mismatch=0, lacks=1):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (match if x == y else mismatch), above[j + 1] - lacks, row[j] - lacks))
        best, above = max(best, *row), row
    return best


def test_local_scores():
    rng = random.Random(1)
    a = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    b = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 25))) for _ in range(300)]
    for scores in ((2, 0, 1), (1, -3, 2)):
        assert loci.local_scores(a, b, *scores).tolist() == [plain_local(x, y, *scores) for x, y in zip(a, b, strict=True)]


def test_local_alignment_of_a_table(spark):
    df = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", None), ("", "A"), ("ACGTTT", "CGTT")], "a string, b string")
    assert [r.score for r in loci.local_alignment(df, "a", "b").collect()] == [8, None, 0, 8]


def test_alignments_are_the_best_and_spell_both_sequences():
    rng = random.Random(2)
    for _ in range(200):
        centre = "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 40)))
        tag = list(centre)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(tag))
            tag[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "A", "C", "G", "T"])
        tag = "".join(tag) or "A"
        told = loci._aligned([tag], [centre])[0]
        spelled = "".join(x for _, _, x in told if x != "-")
        assert tag.startswith(spelled) and [c for c, k, _ in told if k == 0] == list(range(len([1 for _, k, _ in told if k == 0])))
        score = sum(loci.LACKS if x == "-" or k else loci.MATCH if x == centre[c] else loci.MISMATCH for c, k, x in told)
        h = [[loci.LACKS * c for c in range(len(centre) + 1)]]
        for x in tag:
            row = [h[-1][0] + loci.LACKS]
            for j, y in enumerate(centre):
                row.append(max(h[-1][j] + (loci.MATCH if x == y else loci.MISMATCH), h[-1][j + 1] + loci.LACKS, row[j] + loci.LACKS))
            h.append(row)
        assert score == max(*h[-1], *(row[-1] for row in h))


def test_planted_variants_are_found(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(64))
    snp = base[:20] + ("A" if base[20] != "A" else "C") + base[21:]
    short = (base[:30] + base[31:] + "ACGT")[:64]  # lacks base 30
    long = (base[:40] + ("G" if base[40] != "G" and base[39] != "G" else "T") + base[40:])[:64]  # one more after base 39
    place = {base: 1, snp: 1, short: 1, long: 1}
    tags = spark.createDataFrame([(t, 1, s, 1000) for t, s in place.items()] + [("A" * 64, 1, 1, 5), ("C" * 64, None, None, None)], "tag string, chrom int, strand int, pos int")
    rows = [(base, x, 30) for x in range(20)] + [(snp, x, 30) for x in range(10, 30)] + [(short, x, 25) for x in range(30, 40)] + [(long, x, 25) for x in range(40, 50)] + [("A" * 64, 1, 3)]
    counts = spark.createDataFrame(rows, "tag string, taxon int, count int")
    found = loci.discover(tags, counts, min_mac=5).collect()
    assert {(r.site_pos, r.ins) for r in found} == {(1020, 0)}
    call = {r.taxon: tuple(sorted((r.a1, r.a2))) for r in found}
    a, b = "ACGT".index(base[20]), "ACGT".index(snp[20])
    assert call[0] == (a, a) and call[29] == (b, b) and call[15] == tuple(sorted((a, b))) and call[35] == (a, a)
    gaps = {(r.site_pos, r.ins) for r in loci.discover(tags, counts, min_mac=5, with_gaps=True).collect()}
    near = [1000 + i for i in range(28, 34)]
    assert (1020, 0) in gaps and any((p, 0) in gaps for p in near) and any(k == 1 and 1036 <= p <= 1042 for p, k in gaps) and len(gaps) == 3


def test_minus_strand_is_told_on_the_plus_strand(spark):
    base = "ACGTTGCAAC" * 3
    other = base[:12] + "T" + base[13:]
    tags = spark.createDataFrame([(base, 2, -1, 500), (other, 2, -1, 500)], "tag string, chrom int, strand int, pos int")
    counts = spark.createDataFrame([(base, 1, 9), (other, 2, 9), (base, 3, 5), (other, 3, 5)], "tag string, taxon int, count int")
    got = {r.taxon: (r.site_pos, r.a1, r.a2) for r in loci.discover(tags, counts, min_mac=1).collect()}
    x, y = "TGCA".index(base[12]), "TGCA".index("T")
    assert got[1] == (488, x, x) and got[2] == (488, y, y) and got[3][0] == 488 and {*got[3][1:]} == {x, y}


def sam_line(rng, i):
    """A line and what it should say."""
    ref = "".join(rng.choice("ACGT") for _ in range(60))
    pos, flag = rng.randint(1, 5000), rng.choice([0, 16])
    read, cigar, md, want, run = [], [], [], [], 0

    def put(op, n):
        if cigar and cigar[-1][0] == op:
            cigar[-1][1] += n
        else:
            cigar.append([op, n])

    if rng.random() < 0.3:
        read.append("ACG")
        put("S", 3)
    r = 0
    while r < 50:
        kind = rng.random() if 3 < r < 45 else 1
        if kind < 0.06:
            alt = rng.choice([x for x in "ACGT" if x != ref[r]])
            md += [str(run), ref[r]]
            run = 0
            read.append(alt)
            want.append((pos + r, ref[r], alt))
            put("M", 1)
            r += 1
        elif kind < 0.1 and cigar[-1][0] == "M":
            n = rng.randint(1, 3)
            md += [str(run), "^" + ref[r : r + n]]
            run = 0
            want.append((pos + r, ref[r : r + n], "-"))
            put("D", n)
            r += n
            read.append(ref[r])
            put("M", 1)
            run += 1
            r += 1
        elif kind < 0.14 and cigar[-1][0] == "M":
            n = rng.randint(1, 2)
            x = "".join(rng.choice("ACGT") for _ in range(n))
            read.append(x)
            want.append((pos + r - 1, "-", x))
            put("I", n)
            read.append(ref[r])
            put("M", 1)
            run += 1
            r += 1
        else:
            read.append(ref[r])
            put("M", 1)
            run += 1
            r += 1
    md.append(str(run))
    seq = "".join(read)
    line = "\t".join([f"r{i}", str(flag), "chr7", str(pos), "60", "".join(f"{n}{op}" for op, n in cigar), "*", "0", "0", seq, "*", "NM:i:2", "MD:Z:" + "".join(md), "X0:i:3"])
    return line, (f"r{i}", -1 if flag else 1, pos, pos + r - 1, sorted(want), seq)


def test_sam_variants_by_place(spark, tmp_path):
    rng = random.Random(4)
    made = [sam_line(rng, i) for i in range(200)]
    odd = "\t".join(["un", "4", "*", "0", "0", "*", "*", "0", "0", "ACGT", "*"])
    (tmp_path / "x.sam").write_text("@HD\tVN:1\n" + "\n".join(line for line, _ in made) + "\n" + odd + "\n")
    got = {r.name: r for r in read_sam(spark, str(tmp_path / "x.sam")).collect()}
    assert len(got) == 201 and got["un"].chrom is None and got["un"].pos is None and got["un"].tag == "ACGT"
    for _, (name, strand, pos, end, want, seq) in made:
        r = got[name]
        assert (r.strand, r.pos, r.end, r.chrom, r.hits, r.divergence) == (strand, pos, end, "chr7", 3, 2)
        assert sorted(tuple(v) for v in r.variants) == want, name
        assert r.tag == (seq if strand == 1 else seq[::-1].translate(str.maketrans("ACGT", "TGCA")))


def test_counts_are_dealt_once_and_bases_never(spark):
    """Above the join of counts and sites there is no exchange; a tag at two places counts at either, and taxa that are null don't count."""
    rows = [("AA", "AC", 1), ("GA", "GC", 2)]
    tags = spark.createDataFrame([(t, 1, 1, 100 * p) for a, b, p in rows for t in (a, b)] + [("AA", 1, 1, 200)], "tag string, chrom int, strand int, pos int")
    counts = spark.createDataFrame([("AA", 1, 2), ("AC", 1, 3), ("AC", 2, 4), ("GA", None, 9), ("GC", None, 9)], "tag string, taxon int, count int")
    kept = loci.tag_loci(tags, counts, 2)
    assert {(r.pos, r.tag, r.centre) for r in kept.collect()} == {(100, "AA", "AC"), (100, "AC", "AC")}
    assert {r.pos for r in loci.tag_loci(tags, counts).collect()} == {100, 200}
    told = loci.site_depths(loci.locus_sites(loci.aligned_bases(kept)), counts)
    assert {(r.site_pos, r.taxon): r.depth for r in told.collect()} == {(101, 1): [2, 3, 0, 0, 0, 0], (101, 2): [0, 4, 0, 0, 0, 0]}
    plan = told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
