"""Golden rows: catalog views over hand-written rows shaped like the sample
asset files, expected cells derived by hand from the view semantics."""

from skyledger.catalog import VIEWS, search_manifest
from skyledger.operators import views as V


def test_iam_view(spark):
    df = spark.createDataFrame(
        [(0, "alice", "AID1", "2023-01-05", None, True, 2, ["admins", "dev"], "active", "2024-01-01"),
         (1, "bob", "AID2", "2023-02-05", "2024-01-02", False, 0, [], "removed", "2024-01-01"),
         (2, "carol", "AID3", "2023-03-05", "", False, 1, None, "active", "2024-01-01")],
        "_ordinal long, user_name string, user_id string, created_date string, password_last_used string, "
        "mfa_enabled boolean, access_keys bigint, groups array<string>, status string, discovery_date string")
    rows = [r.asDict() for r in V.table_view(df, VIEWS["aws/iam"], sort_col=1).collect()]
    assert [r["user_name"] for r in rows] == ["alice", "carol"]            # removed row dropped
    a, c = rows
    assert (a["password_last_used"], a["mfa_enabled"], a["groups"]) == ("Never", "Enabled", "admins, dev")
    assert (c["password_last_used"], c["mfa_enabled"], c["groups"]) == ("Never", "Disabled", "-")
    assert a["account"] is None                                            # absent field


def test_s3_and_bigquery_views(spark):
    s3 = spark.createDataFrame(
        [(0, "logs", "us-east-1", "2023-01-01", True, None, False, 12.5, 100, "active"),
         (1, "site", "eu-west-1", "2023-01-02", False, "AES256", True, 0.0, 0, "active")],
        "_ordinal long, bucket_name string, region string, created_date string, versioning boolean, "
        "encryption string, public_access boolean, size_gb double, object_count bigint, status string")
    rows = {r["bucket_name"]: r for r in V.table_view(s3, VIEWS["aws/s3"]).collect()}
    assert (rows["logs"]["versioning"], rows["logs"]["encryption"], rows["logs"]["public_access"]) == \
        ("Enabled", "None", "Private")
    assert (rows["site"]["versioning"], rows["site"]["encryption"], rows["site"]["public_access"]) == \
        ("Disabled", "AES256", "Public")
    bq = spark.createDataFrame([(0, "ds1", "p", "US", 3600000, "active"), (1, "ds2", "p", "EU", None, "active")],
                               "_ordinal long, dataset_id string, project string, location string, "
                               "default_table_expiration bigint, status string")
    got = {r["dataset_id"]: r["default_table_expiration"] for r in V.table_view(bq, VIEWS["gcp/bigquery"]).collect()}
    assert got == {"ds1": "3600000ms", "ds2": "Never"}


def test_ad_users_view_sorted_desc(spark):
    df = spark.createDataFrame(
        [(0, "Zed", "z@x", "Member", None, "Ops", "2023", None, True, True, "active"),
         (1, "amy", "a@x", "Guest", "Sales", None, "2023", "2024-01-01", False, False, "active")],
        "_ordinal long, display_name string, user_principal_name string, user_type string, department string, "
        "job_title string, created_date string, last_sign_in string, mfa_registered boolean, "
        "account_enabled boolean, status string")
    rows = [r.asDict() for r in V.table_view(df, VIEWS["azure/ad-users"], sort_col=1, direction="desc").collect()]
    assert [r["display_name"] for r in rows] == ["Zed", "amy"]              # case-insensitive text order
    assert (rows[0]["department"], rows[0]["last_sign_in"], rows[0]["mfa_registered"]) == ("-", "Never", "Registered")
    assert (rows[1]["job_title"], rows[1]["account_enabled"], rows[1]["mfa_registered"]) == \
        ("-", "No", "Not Registered")


def test_search_manifest_shape():
    m = search_manifest("/data")
    assert len(m) == 48 and len({e.provider for e in m}) == 8
    ec2 = next(e for e in m if e.provider == "aws" and e.service == "ec2")
    assert (ec2.path, ec2.name_field, ec2.label) == ("/data/aws/ec2.json", "name", "EC2 Instances")
