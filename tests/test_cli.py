"""The job CLI end to end on small landed files."""

import json
import os

from skyledger.cli import main


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(json.dumps(obj))


def test_cli_flow(spark, tmp_path, capsys):
    t = str(tmp_path)
    _write(f"{t}/landed/domains/page-1.json", [{"domain": "a.io", "expires": "2026-01-01T00:00:00Z"},
                                                {"domain": "b.io"}])
    _write(f"{t}/landed/records/domain=a.io/page-1.json", [{"name": "@", "type": "A", "data": "1.2.3.4"},
                                                          {"name": "www", "type": "CNAME", "data": "a.io"}])
    store = f"{t}/store"
    main(["sync", "--provider", "GoDaddy", "--landed-domains", f"{t}/landed/domains",
          "--landed-records", f"{t}/landed/records/*/*.json", "--store", store, "--as-of", "2024-05-01"], spark)
    run = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (run["status"], run["records_found"], run["records_added"]) == ("completed", 4, 4)

    main(["status", "--store", store], spark)
    st = json.loads(capsys.readouterr().out.strip().splitlines()[0])
    assert st["collector_name"] == "godaddy" and st["is_running"] is False

    main(["domains", "--store", store, "--out", f"{t}/out/domains", "--status", "active"], spark)
    got = spark.read.json(f"{t}/out/domains").collect()
    assert sorted(r["domain"] for r in got) == ["a.io", "b.io"]
    main(["records", "--store", store, "--out", f"{t}/out/records", "--domain", "a.io"], spark)
    assert spark.read.json(f"{t}/out/records").count() == 2
    main(["export", "--store", store, "--out", f"{t}/out/all", "--now", "2024-05-01T06:00:00Z"], spark)
    assert spark.read.json(f"{t}/out/all/domains").count() == 2

    _write(f"{t}/data/aws/ec2.json", [{"instance_id": "i-1", "name": "web", "state": "running", "status": "active"},
                                      {"instance_id": "i-2", "name": "db", "public_ip": "1.1.1.1",
                                       "status": "removed"}])
    main(["view", "--data", f"{t}/data/aws/ec2.json", "--view", "aws/ec2", "--sort-col", "2"], spark)
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [(r["name"], r["public_ip"]) for r in rows] == [("web", "-")]
    main(["view", "--data", f"{t}/data/aws/ec2.json", "--view", "aws/ec2", "--summary"], spark)
    out_lines = capsys.readouterr().out.strip().splitlines()
    summary, stats = json.loads(out_lines[0]), json.loads(out_lines[1])
    assert (summary["total"], summary["from_row"], summary["to_row"]) == (1, 1, 1)
    assert (stats["total"], stats["removed"]) == (2, 1)

    main(["index", "--data-dir", f"{t}/data", "--out", f"{t}/index"], spark)
    skipped = capsys.readouterr().out.strip().splitlines()
    assert len(skipped) == 47                                      # every catalog file but ec2 is missing
    main(["search", "--index", f"{t}/index", "--q", "WEB"], spark)
    out = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert out[0]["total_hits"] == 1 and out[1]["name"] == "web" and out[1]["hits"] == 1
