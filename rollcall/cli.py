"""Command line over a project folder: ``python -m rollcall.cli STAGE --root DIR``.

The folder holds ``config`` (games, sources, correction tables, rules) and gets
``raw`` (frozen pages) and ``out``. Stages: fetch, parse, indexes, people, stats, roles, all. The
exit code is 1 if any release fails the parse gate.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, corrections, identity, roles
from .plans import careers
from .shared import materialised
from .sources import documents as io
from .sources import indexes
from .sources.credits import Rules

CONFIG = {"aliases": True, "reviews": True, "name_fixes": True, "studio_fixes": True, "inclusion_overrides": True, "vendor_types": True, "studio_classes": False, "games": False, "sources": False}


STAGES = ["fetch", "parse", "indexes", "people", "stats", "roles"]


class Project:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.out = f"{root}/out"

    def table(self, name: str) -> DataFrame:
        return io.read_table(self.spark, name, f"{self.root}/config/{name}.csv", CONFIG[name])

    def plan(self) -> dict:
        """Continuity groups and eras, by release."""
        path = Path(self.root, "config", "plan.json")
        return json.loads(path.read_text("utf-8")) if path.exists() else {}

    def fetch(self) -> int:
        for s in self.table("sources").toLocalIterator():
            io.freeze(s.url, s.parser, f"{self.root}/{s.raw_path}", options=json.loads(s.options or "{}"))
        return 0

    def rules(self) -> Rules:
        config = f"{self.root}/config"
        return Rules(io.read_rules(self.spark, f"{config}/categories.csv"), io.read_patterns(self.spark, f"{config}/not-people.txt"))

    def docs(self) -> DataFrame:
        """Frozen pages: the table ``landed`` if there is one, else the files of ``raw``."""
        sources, games = self.table("sources"), self.table("games")
        if Path(self.root, "landed").exists():
            return io.read_landed(self.spark, f"{self.root}/landed", sources, games)
        return io.read_frozen(self.spark, f"{self.root}/raw", sources, games)

    def parse(self, threshold: float) -> int:
        """Pages are parsed once, into ``out/parsed``; credits, logs and the report are read from it."""
        curated = Path(self.root, "config", "curated")
        overrides = self.table("inclusion_overrides").withColumn("place", F.monotonically_increasing_id())
        fixes = careers.Corrections(self.table("name_fixes"), self.table("studio_fixes"), io.read_curated(self.spark, str(curated)) if curated.exists() else None, overrides)
        tagged = careers.parse_changes(self.docs(), self.rules(), fixes)
        print(io.write_parse(tagged, f"{self.out}/parsed"))
        parsed = self.spark.read.schema(tagged.schema).parquet(f"{self.out}/parsed")
        io.write_credits(parsed.where("kind = 'row'"), f"{self.out}/credits")
        io.write_audit(parsed, f"{self.out}/audit")
        report = corrections.parse_report(parsed, "game_id", threshold)
        io.write_mart(report, f"{self.out}/report", "game_id")
        report.orderBy("game_id").show(1000, False)
        return int(report.where("failed").count() > 0)

    def indexes(self) -> int:
        """What frozen pages say beside the credits: headings by reference, roles by person, and tags behind names."""
        docs = self.docs()
        wiki, tables = (docs.where(F.col("parser") == p) for p in ("wikitext", "credit_table"))
        headings = indexes.wiki_heading_index(wiki).unionByName(indexes.table_heading_index(tables))
        io.write_mart(headings, f"{self.out}/indexes/headings", "game_id", "source_ref")
        io.write_mart(indexes.explicit_roles(tables), f"{self.out}/indexes/explicit_roles", "game_id", "name")
        fixes = self.table("name_fixes").withColumn("place", F.monotonically_increasing_id())
        io.write_mart(indexes.name_tags(fixes, self.plan().get("not_work", [])), f"{self.out}/indexes/name_tags", "name")
        return 0

    def roles(self) -> int:
        """One role class for each name and release."""
        found = {k: io.read_table(self.spark, k, f"{self.out}/indexes/{k}", True) for k in ("headings", "explicit_roles", "name_tags")}
        config = f"{self.root}/config"
        rules = io.read_rules(self.spark, f"{config}/role_headings.csv", roles.PRIORITY) if Path(config, "role_headings.csv").exists() else []
        rows = io.read_csv(self.spark, f"{self.out}/credits", io.CREDITS.replace("game_id string, ", "") + ", game_id string")
        classes = roles.classify(rows, rules, io.read_rules(self.spark, f"{config}/categories.csv"), found["name_tags"], found["explicit_roles"], self.table("vendor_types"), found["headings"])
        io.write_mart(classes.withColumnRenamed("name_raw", "name"), f"{self.out}/roles", "game_id", "name")
        return 0

    def credits(self) -> DataFrame:
        """Core rows of all releases, in the order of files named by release."""
        rows = io.read_csv(self.spark, f"{self.out}/credits", io.CREDITS.replace("game_id string, ", "") + ", game_id string")
        order = F.struct(F.concat("game_id", F.lit(".csv")).alias("file"), F.col("credit_order").alias("row"), F.col("name_raw").alias("name"))
        return rows.withColumn("ord", order).where("inclusion_class = 'core'")

    def resolved(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        credits = self.credits()
        people, facts = identity.resolve(credits, self.table("games"), self.table("aliases"), self.table("reviews"))
        return credits, materialised(people), materialised(facts)

    def people(self) -> int:
        _, people, _ = self.resolved()
        io.write_people(people, f"{self.out}/people")
        identity.uncertain_review(people).coalesce(1).write.mode("overwrite").csv(f"{self.out}/uncertain", header=True, emptyValue="")
        return 0

    def stats(self) -> int:
        credits, people, facts = self.resolved()
        games, plan = self.table("games"), self.plan()
        seen = materialised(careers.appearances(credits, people, facts, self.table("studio_classes")))
        io.write_mart(careers.per_game(games, seen, plan.get("groups", {})), f"{self.out}/per_game", "sequence")
        io.write_mart(careers.flow_edges(games, seen, plan.get("groups", {})), f"{self.out}/flows", "from_grp", "to_grp")
        if eras := plan.get("eras"):
            io.write_mart(careers.lineages(games, seen, eras), f"{self.out}/lineage", "first_party_only", "release")
        return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="rollcall")
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("--root", default=".")
    p.add_argument("--threshold", type=float, default=0.05)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("rollcall").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    project, code = Project(spark, a.root), 0
    with checks.named(corrections.CorrectionError, identity.PersonIdCollision, identity.RulingError):
        for stage in STAGES if a.stage == "all" else [a.stage]:
            code = code or (project.parse(a.threshold) if stage == "parse" else getattr(project, stage)())
    return code


if __name__ == "__main__":
    raise SystemExit(main())
