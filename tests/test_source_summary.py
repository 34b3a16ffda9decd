"""The mean confidence of a source does not depend on the order of its evidence."""

from tracewright.operators import evidence

KS = [97, 73, 54, 91, 84, 73, 84, 85, 96, 82, 93, 87, 51, 89, 69, 78]


def test_mean_is_exact(spark):
    for ks in (KS, KS[::-1], sorted(KS)):
        known = spark.createDataFrame([(n, "npm", k / 100, 1) for n, k in enumerate(ks)], "id long, source_type string, confidence double, incident_id long").coalesce(1)
        cited = spark.createDataFrame([(1, n) for n in range(len(ks))], "incident_id long, evidence_id long").coalesce(1)
        row = evidence.source_summary(cited, known).first()
        assert (row.evidence_count, row.mean_confidence) == (len(KS), 8038 / 10_000)
