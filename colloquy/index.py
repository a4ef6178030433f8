"""The library's face: an index of conversations in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import enrich as enriching
from .operators import mutate, query
from .operators.graph import Graph, build_graph
from .operators.iterate import cut
from .operators.rank import pagerank
from .sources import store, whatsapp
from .sources.common import Ingested
from .sources.common import ingest as ingest_path


class ConversationIndex:
    """Opens what is stored in ``root`` when first asked. Every query is a DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._graph: Graph | None = None
        self._my_emails: tuple[str, ...] = ()

    def load(self) -> bool:
        self._graph = store.load(self.spark, self.root)
        return self._graph is not None

    def status(self) -> bool:
        return self._graph is not None or store.exists(self.spark, self.root)

    @property
    def graph(self) -> Graph:
        if self._graph is None and not self.load():
            raise LookupError("no index found; ingest something first")
        return self._graph

    def set_my_emails(self, emails) -> None:
        self._my_emails = tuple(e.lower() for e in emails)

    def ingest_tables(self, found: Ingested, **meta) -> DataFrame:
        graph = build_graph(found.messages, found.channels, found.people, meta)
        graph = store.with_rank(graph, pagerank(graph.nodes, graph.edges))
        graph.nodes = cut(graph.nodes)
        store.save(graph, self.root)
        self.load()
        return self.stats()

    def ingest(self, path: str, form: str | None = None) -> DataFrame:
        """Replaces the index by what a path holds."""
        return self.ingest_tables(ingest_path(self.spark, path, form, self._my_emails), ingested_from=path, format=form or "")

    def ingest_text(self, text: str, name: str = "chat") -> DataFrame:
        return self.ingest_tables(whatsapp.ingest_text(self.spark, text, name), ingested_from=f"upload:{name}", format="whatsapp")

    def reindex(self, path: str | None = None, form: str | None = None) -> DataFrame:
        """Builds a new version from where the index came from; the old one stays until that is written."""
        path = path or self.graph.meta.get("ingested_from")
        if not path or path == "merged" or path.startswith(("gmail:", "upload:")):
            raise ValueError("the index has no path to ingest again; name one")
        return self.ingest(path, form or self.graph.meta.get("format") or None)

    def merge(self, path: str, form: str | None = None) -> dict[str, int]:
        """A second source into the index; ranks are computed again."""
        found = ingest_path(self.spark, path, form, self._my_emails)
        other = build_graph(found.messages, found.channels, found.people)
        ordinal = int(self.graph.meta.get("sources", 1)) + 1
        merged, added = mutate.merge_graphs(self.graph, other, ordinal)
        merged.meta["sources"] = ordinal
        merged = store.with_rank(merged, pagerank(merged.nodes, merged.edges))
        store.save(merged, self.root)
        self.load()
        return added

    def _changed(self, graph: Graph) -> None:
        store.save(graph, self.root)
        self.load()

    def _visited(self, node_id: str) -> None:
        store.append(self.graph, self.root, "visits", mutate.visit_row(self.spark, node_id))
        self.load()

    def query(self, text: str) -> DataFrame:
        return query.search(self.graph.nodes, text)

    def people(self, limit: int = 20) -> DataFrame:
        return query.ranked_by_type(self.graph.nodes, "person", limit)

    def channels(self, limit: int = 20) -> DataFrame:
        return query.ranked_by_type(self.graph.nodes, "channel", limit)

    def clusters(self, channel: str | None = None, limit: int | None = None) -> DataFrame:
        return query.top_clusters(self.graph.nodes, channel, limit)

    def person(self, name: str) -> dict | None:
        found = query.person_profile(self.graph, name)
        if found:
            self._visited(found["id"])
        return found

    def traverse(self, node_id: str, hops: int = 2) -> DataFrame | None:
        found = query.traverse(self.graph.nodes, self.graph.edges, node_id, hops)
        if found is not None:
            self._visited(node_id)
        return found

    def annotate(self, node_id: str, **note) -> bool:
        """Adds the rows of a note to the stored tables; nothing else is written."""
        rows = mutate.annotation_rows(self.graph, node_id, **note)
        for name, more in (rows or {}).items():
            store.append(self.graph, self.root, name, more)
        if rows:
            self.load()
        return rows is not None

    def hot(self, limit: int = 20) -> DataFrame:
        return query.hot_nodes(self.graph.nodes, self.graph.visits, self.graph.annotations, limit)

    def stats(self) -> DataFrame:
        return query.stats(self.graph.nodes, self.graph.edges)

    def overview(self) -> tuple[DataFrame, DataFrame]:
        return query.overview(self.graph.nodes, self.graph.edges)

    def export_viz(self, path: str, limit: int = 40) -> None:
        nodes, edges = query.viz_export(self.graph.nodes, self.graph.edges, limit)
        store.export_json(nodes, f"{path}/nodes")
        store.export_json(edges, f"{path}/edges")

    def enrich(self, enricher: enriching.Enricher = enriching.offline, limit: int = 50, force: bool = False, pause_s: float = 0.0) -> dict[str, int]:
        graph, counts = enriching.batch_enrich(self.graph, enricher, limit, force, pause_s)
        self._changed(graph)
        return counts

    def dedup_entities(self) -> int:
        graph, merged = mutate.dedup_entities(self.graph)
        self._changed(graph)
        return merged

    def refresh_pagerank(self) -> None:
        self._changed(store.with_rank(self.graph, pagerank(self.graph.nodes, self.graph.edges)))

    def cluster_enrichment(self, cluster_id: str) -> DataFrame:
        return enriching.enrichment_of(self.graph.annotations, cluster_id)

    def enriched_clusters(self) -> DataFrame:
        return enriching.enriched(self.graph.annotations).where(F.col("id").isNotNull())
