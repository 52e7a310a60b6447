import datetime
import random

from strandlake.operators import filters
from strandlake.streaming import reads as st

SCHEMA = "read_id string, mate int, seq string, at timestamp"


def comp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_streams_pair_filter_and_count_as_batches_do(spark, tmp_path):
    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(40):
        a, b = rng.randrange(300), rng.randrange(300)
        s1, s2 = genome[a : a + 40], comp(genome[b : b + 40])
        if i % 4 == 0:
            s2 = "".join(rng.choice("ACGT") for _ in range(40))
        rows += [(f"r{i}", 1, s1 if i % 8 else None, start + datetime.timedelta(seconds=60 * i)), (f"r{i}", 2, s2, start + datetime.timedelta(seconds=60 * i + (3600 if i == 7 else 90)))]
    rows.append(("alone", 1, genome[:30], start))
    rows.sort(key=lambda r: r[3])
    for k, part in enumerate((rows[:30], rows[30:60], rows[60:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    known = spark.createDataFrame([(genome[i : i + 9],) for i in range(392)], "kmer string")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def run(df, name):
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}").collect()

    pairs = st.paired(stream)
    got = run(st.passing(pairs, known, 9), "passing")
    whole = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    batch = whole.where("mate = 1").selectExpr("read_id", "seq AS seq1").join(whole.where("mate = 2").selectExpr("read_id", "seq AS seq2"), "read_id")
    want = {r.read_id for r in filters.positive_filter(batch, known, 9).where("passed").collect()} - {"r7"}
    assert {r.read_id for r in got} == want and len(got) == len(want) > 20
    counts = run(st.coverage(stream, "10 minutes"), "coverage")
    by = {}
    for _, _, seq, at in rows:
        key = at.replace(minute=at.minute // 10 * 10, second=0)
        n, m = by.get(key, (0, 0))
        by[key] = (n + 1, m + len(seq or ""))
    assert len(counts) >= 2 and all(by[r.start] == (r.n_reads, r.n_bases) for r in counts)
