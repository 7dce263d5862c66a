from tidemark.functions import identity as ident

SCHEMA = (
    "source string, source_id string, title string, company string, location string, "
    "employment_type string, salary_min double, salary_max double, description string, "
    "apply_url string, published_at string"
)
BACKEND = "Build backend services using Python and AWS."
POSTINGS = [
    ("himalayas", "h-001", "Software Engineer - Backend", "Acme", "Bengaluru", "Full Time",
     800000.0, 1200000.0, BACKEND, "https://a.example/job1", "2026-10-01"),
    ("jobicy", "j-999", "Backend Software Engineer", "ACME", "Bangalore", "Full-Time",
     800000.0, 1200000.0, BACKEND, "https://b.example/job999", "2026-10-01"),
    ("jobicy", "j-999", "Backend Software Engineer", "ACME", "Bangalore", "Full-Time",
     1000000.0, 1400000.0, BACKEND, "https://b.example/job999", "2026-10-02"),
    ("jobicy", "j-999", "Backend Software Engineer", "ACME", "Bangalore", "Full-Time",
     800000.0, 1200000.0, "Build backend services using Python, AWS and Docker.",
     "https://b.example/job999", "2026-10-02"),
    ("remoteok", "r-555", "Data Scientist", "Acme", "Bangalore", "Full Time",
     900000.0, 1500000.0, "Build machine learning models.", "https://c.example/job555", "2026-10-02"),
]


def test_duplicate_cases(spark):
    rows = ident.finalize(spark.createDataFrame(POSTINGS, SCHEMA)).collect()
    ids = [r.canonical_job_id for r in rows]
    hashes = [r.content_hash for r in rows]
    assert ids[0] == ids[1] == ids[2] == ids[3] != ids[4]
    assert hashes[0] == hashes[1]
    assert hashes[2] != hashes[1] and hashes[3] != hashes[1]
    assert {r.employment_type for r in rows} == {"FULL_TIME"}
    assert all(len(i) == 16 for i in ids) and all(len(h) == 64 for h in hashes)


def test_known_identity(spark):
    df = spark.createDataFrame(
        [("AF Group", "Senior Product Manager - Multiline (Remote US Residency)", "United States")],
        "company string, title string, location string",
    )
    assert df.select(ident.canonical_id()).first()[0] == "4ef95ef00b5510ae"
    assert df.select(ident.canonical_id(exact=True)).first()[0] == "4ef95ef00b5510ae"


def test_known_content_hash(spark):
    import hashlib

    raw = "|".join([
        "company=acme",
        "description=build backend services using python and aws.",
        "employment_type=FULL_TIME",
        "location=bangalore",
        "salary_max=1200000",
        "salary_min=800000",
        "title=backend engineer software",
    ])
    row = ident.finalize(spark.createDataFrame(POSTINGS[:1], SCHEMA)).first()
    assert row.content_hash == hashlib.sha256(raw.encode()).hexdigest()
    raw = "|".join(["software engineer backend", "acme", "bengaluru", "full time", "800000",
                    "1200000", "build backend services using python and aws.",
                    "https a.example job1"])
    got = spark.createDataFrame(POSTINGS[:1], SCHEMA).select(ident.comparison_hash()).first()[0]
    assert got == hashlib.sha256(raw.encode()).hexdigest()


def test_fallback_ids(spark):
    df = spark.createDataFrame(
        [("", "u", "c", "t", "l"), (None, "", "c", "t", "l"), ("x", "u", "c", "t", "l")],
        "source_id string, apply_url string, company string, title string, location string",
    )
    assert [r[0] for r in df.select(ident.external_id()).collect()] == ["u", "c|t|l", "x"]
