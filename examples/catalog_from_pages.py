"""From recorded answers of the sources to a catalog that is synced, enriched, searched and exported.

    python examples/catalog_from_pages.py RECORDED OUT [QUERY]

RECORDED is a folder that `marquetry.sources.clients.recording` has filled while the sources were asked once; nothing here goes
to the network. OUT gets the catalog and its documents as gzipped JSON lines.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from marquetry.functions.scalars import first_search_token  # noqa: E402
from marquetry.sources.clients import EPISODES, SOURCES, Client, recorded  # noqa: E402
from marquetry.streaming.sync import Sync, generate_database  # noqa: E402


def run(spark: SparkSession, folder: str, out: str, query: str | None = None) -> dict:
    """What was done, step by step."""
    answers = recorded(folder)
    sources = {name: kind(Client(name, answers, sleep=lambda seconds: None)) for name, kind in SOURCES.items()}
    catalog, report = generate_database(spark, f"{out}/catalog", sources, max_pages=2)
    done = {"synced": {f"{o.source}:{o.media_kind}": o.upserted for o in report.outcomes}}
    kinds = {"jikan": "anime", "kitsu": "anime", "tvmaze": "show"}
    fetch = {name: (lambda i, s=sources[name], k=kind: s.episodes(k, i)) for name, kind in kinds.items()}
    project = {name: (lambda rows, n=name, k=kind: EPISODES[n](rows, k)) for name, kind in kinds.items()}
    failed = Sync(catalog, paced=False).enrich_episodes(fetch, project)
    done |= {"media": catalog.media().count(), "episodes": catalog.table("episode").count(), "failed": failed.count()}
    if query is None:
        title = catalog.media().orderBy("media_id").select(first_search_token(F.col("title_display"))).first()
        query = title[0] if title else "nothing"
    done["found"] = [(r["media_kind"], r["title_display"]) for r in catalog.search(query).collect()]
    shared = catalog.table("media_external_id").groupBy("media_id").agg(F.countDistinct("source").alias("n")).where("n > 1")
    done["of_several_sources"] = shared.count()
    catalog.export(f"{out}/documents")
    done["exported"] = spark.read.json(f"{out}/documents").count() if done["media"] else 0
    return done


if __name__ == "__main__":
    for name, value in run(SparkSession.builder.appName("catalog from pages").getOrCreate(), *sys.argv[1:]).items():
        print(f"{name}: {value}")
