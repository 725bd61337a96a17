"""Titles of views and removed lists, read off by hand."""

import json

from skyledger import cli
from skyledger.catalog import REMOVED_VIEWS, VIEWS


def _titles(view):
    return [c.title for c in view.columns]


def test_view_titles():
    assert _titles(VIEWS["azure/vms"]) == ["Account", "VM Name", "Resource Group", "Size", "OS", "OS Disk", "Private IP", "Public IP", "Location", "Power State", "Status"]
    assert _titles(VIEWS["aws/iam"]) == ["Account", "User Name", "User ID", "Created", "Last Used", "MFA", "Access Keys", "Groups", "Status", "Discovery Date"]
    assert _titles(VIEWS["aws/vpc"]) == ["Account", "VPC ID", "Name", "CIDR Block", "Region", "Subnets", "Internet Gateway", "NAT Gateways", "Default", "Status"]
    assert _titles(VIEWS["digitalocean/droplets"])[-3:] != [] and "VCPUs" in _titles(VIEWS["digitalocean/droplets"])
    assert "vCPUs" in _titles(VIEWS["alibaba/ecs"]) and "CPU" in _titles(VIEWS["aws/apprunner"])
    assert sum(len(v.columns) for v in VIEWS.values()) == 1064


def test_removed_lists():
    assert {p: len(v) for p, v in REMOVED_VIEWS.items()} == {"alibaba": 4, "azure": 25, "cloudflare": 11, "digitalocean": 5, "dns": 2, "gcp": 22, "oracle": 4}
    assert _titles(REMOVED_VIEWS["gcp"]["gke"]) == ["Account", "Cluster Name", "Version", "Location", "Project", "Removed Date", "Status"]
    assert _titles(REMOVED_VIEWS["dns"]["domains"]) == ["Domain", "Registrar", "Expiration", "Removed Date", "Status"]
    assert _titles(REMOVED_VIEWS["digitalocean"]["droplets"]) == ["Account", "Name", "Size", "Region", "Public IP", "vCPUs", "Removed Date", "Status"]


def test_removed_and_freshness_commands(spark, tmp_path, capsys):
    (tmp_path / "gcp").mkdir()
    gke = [{"name": "c1", "status": "removed", "removed_date": "2024-01-05", "location": "eu", "project": "p"}, {"name": "c2", "status": "active"}]
    (tmp_path / "gcp" / "gke.json").write_text("\n".join(map(json.dumps, gke)))  # JSON lines, as exported
    cli.main(["removed", "--data-dir", str(tmp_path), "--provider", "gcp", "--service", "gke"], spark)
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["name"], r["removed_date"]) for r in rows] == [("c1", "2024-01-05")]
    cli.main(["removed", "--data-dir", str(tmp_path), "--provider", "gcp"], spark)
    assert [json.loads(x)["service_type"] for x in capsys.readouterr().out.splitlines()] == ["GKE"]
    (tmp_path / "m.json").write_text(json.dumps({"services": {"gcp": {"name": "GCP", "schedule": "daily", "last_updated": "2024-01-05T00:00:00Z", "services": {"gke": {"last_updated": "2024-01-05T00:00:00Z"}}}}}))
    cli.main(["freshness", "--metadata", str(tmp_path / "m.json"), "--now", "2024-01-05 10:00:00"], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[0])["freshness"] == "fresh"
    cli.main(["view", "--data", str(tmp_path / "gcp" / "gke.json"), "--view", "gcp/gke"], spark)
    assert [json.loads(x)["location"] for x in capsys.readouterr().out.splitlines()] == [None]  # the active one


def test_rank_and_page_commands(spark, tmp_path, capsys):
    rows = [{"instance_id": f"i-{i}", "name": f"web-{i * 7 % 40}", "status": "removed" if i % 9 == 0 else "active"} for i in range(40)]
    (tmp_path / "ec2.json").write_text(json.dumps(rows))
    cli.main(["rank", "--data", str(tmp_path / "ec2.json"), "--view", "aws/ec2", "--sort-col", "2", "--desc", "--out", str(tmp_path / "i"), "--ranges", "3"], spark)
    cli.main(["page", "--index", str(tmp_path / "i"), "--view", "aws/ec2", "--page", "1", "--rows", "10"], spark)
    *page, summary = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    cli.main(["view", "--data", str(tmp_path / "ec2.json"), "--view", "aws/ec2", "--sort-col", "2", "--desc", "--rows", "50"], spark)
    whole = [json.loads(x)["name"] for x in capsys.readouterr().out.splitlines()]
    assert [r["name"] for r in page] == whole[10:20] and [r["_position"] for r in page] == list(range(11, 21))
    assert summary == {"from_row": 11, "to_row": 20, "total": 35, "pages": 4}
