"""The analysis over an event table, stage by stage.

Sites (groups of users) act as monitored clients. Each stage that several queries read is written
once per session as a parquet table in the shared folder; everything else stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import timing
from tidewatch.operators import (
    campaigns, clean, clients, coalitions, comparators, contexts, evidence, features, partitions, policy,
    projection, ranks, sequential,
)
from tidewatch.params import PARTITIONS, WorkloadParams
from tidewatch.session import written
from tidewatch.sources import flows

_STAGES: dict[tuple, object] = {}

METHODS = {"order_one": (1,), "order_at_most_two": (1, 2), "full": (1, 2, 3)}


def forget_stages() -> None:
    _STAGES.clear()


class Workload:
    def __init__(self, spark: SparkSession, folder: str, params: WorkloadParams | None = None):
        self.spark, self.folder, self.p = spark, folder, params or WorkloadParams()
        # event tables hold UTC wall times without a zone; any other session zone would shift epochs
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    # -- helpers --------------------------------------------------------------------------------

    def _once(self, name: str, build: Callable[[], object]) -> object:
        key = (self.spark.sparkContext.applicationId, self.folder, self.p, name)
        if key not in _STAGES:
            _STAGES[key] = build()
        return _STAGES[key]

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self._once(name, lambda: written(build(), name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def site(self) -> Column:
        """User groups as clients: every user belongs to exactly one site."""
        return F.concat(F.lit("c"), F.lpad((F.col("user_id") % self.p.site_count).cast("string"), 2, "0"))

    # -- records --------------------------------------------------------------------------------

    def flows(self, client: Column | None = None) -> DataFrame:
        attack = F.col("value") >= F.lit(self.p.attack_value)
        path = f"{self.folder}/events.parquet"
        return flows.scan_event_table(self.spark, path, self.site() if client is None else client, attack)

    def user_flows(self) -> DataFrame:
        return self.flows(F.concat(F.lit("u"), F.col("user_id").cast("string")))

    def labelled(self) -> DataFrame:
        return clean.ground_truth(self.flows())

    def raw_flows(self) -> DataFrame:
        """Raw text records derived from every event, with the faults that cleaning must find."""
        e, i = self.table("events"), F.col("event_id")
        seconds = F.format_string("%.6f", timing.naive_seconds(F.col("ts")))
        host = F.concat(F.lit(" 10.0.0."), (F.col("user_id") % self.p.site_count).cast("string"), F.lit("\t"))
        name = F.col("event_type")
        hot = F.col("value") >= self.p.attack_value
        return e.select(
            i.alias("original_order"),
            F.when(i % 97 == 0, "not-a-ts").when(i % 101 == 0, "nan").otherwise(seconds).alias("ts"),
            F.when(i % 89 == 0, " - ").when(i % 83 == 0, "  ").otherwise(host).alias("src_ip"),
            F.when(i % 7 == 0, "-").when(i % 5 == 0, F.initcap(name)).otherwise(name).alias("proto"),
            F.when(i % 11 == 0, "").when(i % 13 == 0, F.lit(None)).otherwise(F.substring(name, 1, 4)).alias("service"),
            F.when(i % 79 == 0, "bad").when(hot, "1").otherwise("0").alias("label"),
            F.when(i % 73 == 0, " ").when(hot & (i % 3 != 0), F.concat(F.lit(" D"), name)).otherwise(" Normal").alias("type"),
        )

    def raw_packets(self) -> DataFrame:
        e, i = self.table("events"), F.col("event_id")
        micros = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        name = F.col("event_type")
        hot = F.col("value") >= self.p.attack_value

        def column(kind: str, payload: str) -> Column:
            return F.when(name == kind, F.lit(payload)).otherwise(F.when(i % 2 == 0, "0").otherwise("0.0"))

        return e.select(
            i.alias("original_order"),
            F.when(i % 97 == 0, micros)
            .when(i % 3 == 0, F.concat(micros, F.lit("+02:00")))
            .when(i % 3 == 1, F.concat(micros, F.lit("Z")))
            .otherwise(F.format_string("%.6f", timing.naive_seconds(F.col("ts"))))
            .alias("frame.time"),
            F.when(i % 89 == 0, F.lit("")).otherwise(F.concat(F.lit("h"), (F.col("user_id") % self.p.site_count).cast("string"))).alias("ip.src_host"),
            column("view", "arp-request").alias("arp.opcode"),
            column("click", "GET").alias("http.request"),
            F.when(name.isin("click", "purchase"), "2").otherwise("-").alias("tcp.flags"),
            column("signup", "53").alias("udp.port"),
            F.when(hot, "1").otherwise("0").alias("Attack_label"),
            F.when(hot, "DDoS_UDP").otherwise("Normal").alias("Attack_type"),
        )

    def with_copies(self, conflict: bool = False) -> DataFrame:
        """Events and later copies of every tenth one; with ``conflict`` some copies disagree."""
        base = self.flows().select("original_order", "uid", "client_id", "ts_seconds", "event_type", "payload")
        copy = base.filter(F.col("original_order") % 10 == 3).withColumn(
            "original_order", F.col("original_order") + 1_000_000_000
        )
        late = copy.withColumn("ts_seconds", F.col("ts_seconds") + F.when(F.col("original_order") % 20 == 3, 30.0).otherwise(0.0))
        if conflict:
            late = late.withColumn("payload", F.when(F.col("original_order") % 100 == 3, "changed").otherwise(F.col("payload")))
        return base.unionByName(late)

    def with_mixed_copies(self, conflict: bool = False) -> DataFrame:
        """Every tenth event six times, a third of the copies without identifier and others under a second one, at three times
        out of order; every third other event without identifier. With ``conflict`` some copies disagree."""
        base = self.flows().select("original_order", "uid", "client_id", "ts_seconds", "event_type", "payload")
        o, v = F.col("original_order"), F.col("v")
        often = base.filter(o % 10 == 3).withColumn("v", F.explode(F.array(*[F.lit(i).cast("long") for i in range(6)])))
        uid = F.when((F.floor(o / 10) + v) % 3 == 0, F.lit(None)).when(v % 2 == 1, F.col("uid")).otherwise(F.concat("uid", F.lit("b")))
        changed = (v == 4) & (o % 100 == 13) if conflict else F.lit(False)
        often = often.select(
            (o * 8 + (v * 3 + o) % 8).alias("original_order"), uid.alias("uid"), "client_id", (F.col("ts_seconds") + 30 * ((o + 2 * v) % 3)).alias("ts_seconds"),
            "event_type", F.when(changed, "changed").otherwise(F.col("payload")).alias("payload"),
        )
        once = base.filter(o % 10 != 3).withColumn("uid", F.when(o % 3 == 0, F.lit(None)).otherwise(F.col("uid")))
        return once.withColumn("original_order", o * 8).unionByName(often)

    # -- clients and epochs ---------------------------------------------------------------------

    def sparse(self) -> DataFrame:
        p = self.p
        return self.stage("sparse", lambda: features.bucket_counts(self.labelled(), p.epoch_seconds, p.hash_buckets))

    def selected(self) -> DataFrame:
        p = self.p

        def build() -> DataFrame:
            per_epoch = self.sparse().groupBy("client_id", "epoch").agg(F.sum("n_benign").alias("n")).filter("n > 0")
            tally = per_epoch.groupBy("client_id").agg(F.sum("n").alias("benign_records"), F.count("*").alias("benign_epochs"))
            judged = clients.eligibility(tally, p.minimum_benign_records, p.minimum_benign_epochs)
            return clients.select_flexible(judged, p.target_clients, p.minimum_clients)

        return self.stage("selected", build)

    def client_ids(self) -> list[str]:
        """At most ``target_clients`` names."""
        return self._once("client_ids", lambda: sorted(r[0] for r in self.selected().select("client_id").collect()))

    def interval(self) -> DataFrame:
        dense = self.sparse().filter("n_benign > 0")
        return features.common_interval(dense, self.selected())

    def grid(self) -> DataFrame:
        """Dense epochs of the benign stream and of all records, with roles and positions."""
        p = self.p

        def build() -> DataFrame:
            parts = []
            for stream, count in (("benign", "n_benign"), ("all", "n")):
                dense = features.dense_counts(self.sparse(), count, p.hash_buckets)
                full = features.dense_grid(dense, self.selected(), self.interval(), p.hash_buckets)
                parts.append(full.withColumn("stream", F.lit(stream)))
            both = parts[0].unionByName(parts[1])
            return partitions.assign_partitions(both, p.fractions).select(
                "stream", "client_id", "epoch", "pos", "epochs", "partition", "part_pos", "part_size", "counts"
            )

        return self.stage("grid", build)

    def feature_rows(self, factor: float = 1.0) -> DataFrame:
        g = self.grid()
        return g.select(*[c for c in g.columns if c != "counts"], *features.feature_columns(factor))

    def scaler(self) -> DataFrame:
        fit = self.feature_rows().filter((F.col("stream") == "benign") & (F.col("partition") == PARTITIONS[0]))
        return self.stage("scaler", lambda: features.fit_scaler(features.require_finite(fit)))

    def scored(self, factor: float = 1.0) -> DataFrame:
        """Scores keep six decimals so that equal feature rows tie exactly."""
        rows = features.apply_scaler(self.feature_rows(factor), self.scaler(), self.p.iqr_floor)
        return features.distance_score(rows).withColumn("score", F.round("score", 6))

    def scores(self) -> DataFrame:
        return self.stage("scores", lambda: self.scored().drop("features", "scaled"))

    def benign(self, partition: str) -> DataFrame:
        return self.scores().filter((F.col("stream") == "benign") & (F.col("partition") == partition))

    def ranks(self) -> DataFrame:
        return self.stage(
            "ranks", lambda: ranks.marginal_ranks(self.scores(), self.benign(PARTITIONS[1]), self.p.rank_epsilon)
        )

    def rank_partition(self, partition: str) -> DataFrame:
        return self.ranks().filter((F.col("stream") == "benign") & (F.col("partition") == partition))

    def horizons(self, rows: DataFrame, partition: str) -> DataFrame:
        """Benign rows of a partition cut into complete horizons."""
        part = rows.filter((F.col("stream") == "benign") & (F.col("partition") == partition))
        return partitions.assign_horizons(part, self.p.horizon)

    # -- campaigns ------------------------------------------------------------------------------

    def epoch_labels(self) -> DataFrame:
        joined = self.labelled().join(self.selected().select("client_id"), "client_id", "left_semi")
        return self.stage("epoch-labels", lambda: clean.epoch_labels(joined, self.p.epoch_seconds))

    def epoch_runs(self) -> DataFrame:
        return self.stage("epoch-runs", lambda: campaigns.epoch_runs(self.epoch_labels(), self.p.merge_gap))

    def judged_runs(self) -> DataFrame:
        p = self.p
        axis = self.epoch_labels().agg(F.min("epoch").alias("first_epoch"))
        spread = campaigns.run_spread(campaigns.run_participants(self.epoch_labels(), self.epoch_runs()))
        return campaigns.judged_runs(
            campaigns.merged_runs(self.epoch_runs()), spread, axis, p.first_activity_window, p.support_clients,
            p.minimum_duration, p.warmup,
        )

    def registry(self) -> DataFrame:
        return self.stage("registry", lambda: campaigns.campaign_registry(self.judged_runs(), self.p.dataset))

    # -- coalitions and contexts ----------------------------------------------------------------

    def panel(self, dropout: float = 0.0) -> DataFrame:
        rows = self.ranks()
        up = coalitions.availability_dropout(F.col("client_id"), F.col("epoch"), 7, dropout) if dropout else F.lit(True)
        carry = ("partition", "part_pos", "part_size")
        return coalitions.epoch_panel(rows.withColumn("available", up), self.client_ids(), ["stream"], self.p.outside_lag, carry)

    def coalition_rows(self, variant: str = "exact", max_order: int | None = None, dropout: float = 0.0) -> DataFrame:
        """Active coalition epochs with marginal ranks ``u`` and context histogram ``hist``."""
        p, r = self.p, max_order or self.p.maximum_order
        panel = contexts.federation_bins(self.panel(dropout), p.histogram_bins)
        keys = ["stream", "partition", "part_pos", "part_size", "_bins", "_counts", "_n"]
        rows = coalitions.coalition_epochs(panel, keys, self.client_ids(), r, p.outside_minimum, p.outside_fraction)
        if variant == "exact":
            hist = contexts.exact_histogram(F.col("idx"), F.col("_bins"), F.col("_counts"), F.col("avail"), F.col("_n"))
        else:
            hist = contexts.outside_histogram(variant, F.col("idx"), F.col("lagged"), F.col("avail"), p.histogram_bins)
        return rows.select(
            "coalition_id", "idx", "ord", "stream", "epoch", "partition", "part_pos", "part_size", "u", "active", hist.alias("hist")
        )

    def training_rows(self, rows: DataFrame | None = None) -> DataFrame:
        base = self.coalition_rows() if rows is None else rows
        return base.filter((F.col("stream") == "benign") & (F.col("partition") == PARTITIONS[1]) & F.col("active")).select(
            F.lit(self.p.dataset).alias("dataset"), "ord", F.split("coalition_id", r"\|").alias("members"), "epoch", "hist"
        )

    def _kmeans(self, rows: DataFrame, by: tuple[str, ...] = ("ord",)) -> DataFrame:
        p = self.p
        return contexts.fit_centroids(rows, p.cells, p.kmeans_restarts, p.kmeans_iterations, p.kmeans_tolerance, p.tie_tolerance, p.context_seed, by)

    def centroids(self) -> DataFrame:
        """K-means over all training rows, with restarts."""
        return self.stage("centroids", lambda: self._kmeans(self.training_rows()))

    def cells(self) -> DataFrame:
        """Active coalition epochs with their context cell."""

        def build() -> DataFrame:
            rows = self.coalition_rows().filter("active")
            return contexts.assign_cells(rows, self.centroids(), self.p.tie_tolerance).drop("hist", "active")

        return self.stage("cells", build)

    def _is_nuisance(self) -> Column:
        return (F.col("stream") == "benign") & (F.col("partition") == PARTITIONS[1])

    def nuisance(self) -> DataFrame:
        return self.cells().filter(self._is_nuisance())

    def support(self) -> DataFrame:
        return self.stage("support", lambda: contexts.cell_support(self.nuisance(), self.p.support_minima))

    def conditional(self) -> DataFrame:
        """Supported coalition epochs with conditional ranks ``r``."""

        def build() -> DataFrame:
            ok = self.support().filter("supported").select("coalition_id", "cell")
            rows = self.cells().join(ok, ["coalition_id", "cell"], "left_semi")
            # read once per member slot, so it is a table of its own: distinct values, not rows
            table = self.stage("conditional-rank-table", lambda: ranks.conditional_rank_table(rows, self._is_nuisance()))
            return ranks.conditional_ranks(rows, table, self.p.maximum_order, self.p.rank_epsilon)

        return self.stage("conditional", build)

    def conditional_nuisance(self) -> DataFrame:
        return self.conditional().filter((F.col("stream") == "benign") & (F.col("partition") == PARTITIONS[1]))

    # -- projection and evidence ----------------------------------------------------------------

    def _size(self, check: bool) -> tuple[int, int, tuple[float, ...]]:
        p = self.p
        return (p.check_basis, p.check_order, p.check_candidates) if check else (p.basis_size, p.maximum_order, p.ridge_candidates)

    def folded(self) -> DataFrame:
        rows = self.conditional_nuisance().select("coalition_id", "ord", "cell", "epoch", "r")
        return self.stage("folded", lambda: projection.with_folds(rows, self.p.folds))

    def fits(self, check: bool = False) -> DataFrame:
        size, order, candidates = self._size(check)
        p = self.p
        return self.stage(
            f"fits-{check}",
            lambda: projection.fit_projections(
                self.folded().filter(F.col("ord") <= order), size, candidates, p.folds, p.tie_tolerance, p.svd_cutoff
            ),
        )

    def innovations(self, check: bool = False) -> DataFrame:
        size, order, _ = self._size(check)
        return self.stage(
            f"innovations-{check}",
            lambda: projection.held_innovations(self.folded().filter(F.col("ord") <= order), self.fits(check), size),
        )

    def moments(self, check: bool = False) -> DataFrame:
        size, order, _ = self._size(check)
        return projection.innovation_moments(self.innovations(check), size, order)

    def calibrated(self, check: bool = False) -> DataFrame:
        p = self.p

        def build() -> DataFrame:
            moments = self.moments(check)
            norms = projection.norm_reference(self.innovations(check), moments, p.norm_quantile, p.scale_floor)
            return projection.calibration(self.fits(check), moments, norms)

        return self.stage(f"calibrated-{check}", build)

    def evidence(self, check: bool = False, purify: bool = True) -> DataFrame:
        """Evidence factor of every supported coalition epoch."""
        p = self.p
        size, order, _ = self._size(check)

        def build() -> DataFrame:
            rows = self.conditional().filter(F.col("ord") <= order)
            scored = projection.score_rows(rows, self.calibrated(check), size, p.scale_floor, purify)
            return evidence.coalition_evidence(scored, p.norm_floor, p.clip_bound, p.bet).select(
                "coalition_id", "ord", "cell", "stream", "epoch", "partition", "part_pos", "part_size", "atom", "q_norm", "factor"
            )

        return self.stage(f"evidence-{check}-{purify}", build)

    def epoch_axis(self) -> DataFrame:
        return self.grid().select("stream", "epoch", "partition", "part_pos", "part_size").distinct()

    def order_evidence(self, check: bool = False) -> DataFrame:
        """Mean factor per order for every epoch (columns ``e1``..)."""
        _, order, _ = self._size(check)
        keys = ["stream", "epoch", "partition", "part_pos", "part_size"]
        orders = tuple(range(1, order + 1))
        return self.stage(
            f"order-evidence-{check}",
            lambda: evidence.order_evidence(self.evidence(check), keys, orders, self.epoch_axis()),
        )

    def method_evidence(self, check: bool = False) -> DataFrame:
        _, order, _ = self._size(check)
        methods = {m: o for m, o in METHODS.items() if max(o) <= order}
        return evidence.combine_orders(
            self.order_evidence(check), ["stream", "epoch", "partition", "part_pos", "part_size"], methods
        )

    def horizon_rows(self, rows: DataFrame, partition: str) -> DataFrame:
        return self.horizons(rows.drop("pos"), partition).withColumnRenamed("h_pos", "pos")

    def support_rows(self, keys: list[str], placed: DataFrame, check: bool = False) -> DataFrame:
        """Distributed support of every method; ``placed`` maps epochs to ``keys`` and ``pos``."""
        p = self.p
        _, order, _ = self._size(check)
        methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(max(o)).alias("top")) for m, o in METHODS.items() if max(o) <= order]))
        material = self.evidence(check).filter(F.col("factor") >= p.material_evidence).select(
            "stream", "epoch", "ord", "factor", F.split("coalition_id", r"\|").alias("members"), methods.alias("mm")
        ).filter(F.col("ord") <= F.col("mm.top"))
        rows = material.join(placed, ["stream", "epoch"]).withColumn("method", F.col("mm.method"))
        return sequential.distributed_support(rows, ["method", *keys], p.material_evidence, p.support_window, p.support_clients)

    def horizon_states(self, partition: str, check: bool = False) -> DataFrame:
        rows = self.horizon_rows(self.method_evidence(check), partition)
        keys = ["method", "horizon_id"]
        states = sequential.global_state(rows, keys)
        placed = self.horizon_rows(self.epoch_axis(), partition).select("stream", "epoch", "horizon_id", "pos")
        return sequential.with_support(states, self.support_rows(["horizon_id"], placed, check), keys)

    def false_stop_counts(self, partition: str, check: bool = False) -> DataFrame:
        stops = sequential.global_stops(self.horizon_states(partition, check), ["method", "horizon_id"], self.p.thresholds)
        return sequential.false_stop_counts(stops, ["method"])

    def thresholds(self, check: bool = False) -> DataFrame:
        p = self.p
        return self.stage(
            f"thresholds-{check}",
            lambda: sequential.calibrated_threshold(
                self.false_stop_counts(PARTITIONS[2], check), ["method"], p.confidence, p.pfa_target
            ),
        )

    def campaign_states(self, check: bool = False) -> DataFrame:
        """Replay of every campaign: state and support restart at its first epoch."""
        p = self.p
        frame = campaigns.replay_frame(self.registry(), p.horizon, 0).withColumnRenamed("c_pos", "pos")
        rows = self.method_evidence(check).filter("stream = 'all'").join(frame, "epoch")
        keys = ["method", "checksum"]
        states = sequential.global_state(rows, keys)
        placed = frame.select(F.lit("all").alias("stream"), "epoch", "checksum", "pos")
        return sequential.with_support(states, self.support_rows(["checksum"], placed, check), keys)

    def campaign_stops(self, check: bool = False) -> DataFrame:
        stops = sequential.global_stops(self.campaign_states(check), ["method", "checksum"], self.p.thresholds)
        return stops.join(self.thresholds(check).select("method", "threshold"), ["method", "threshold"])

    # -- cross-fitting of the whole chain --------------------------------------------------------

    def cross_fitted(self, check: bool = False) -> DataFrame:
        """Innovations of nuisance epochs from a chain that never saw their fold.

        The nuisance split is cut into contiguous folds. For each held fold, marginal ranks,
        centroids, conditional ranks and the projection are fitted on the other folds only. The
        held fold is a key column (``folds`` copies of the nuisance epochs), so one plan serves all.
        """
        p = self.p
        size, order, candidates = self._size(check)
        by = ("held", "ord")

        def ranks_of() -> DataFrame:
            n, pos = F.col("part_size"), F.col("part_pos")
            own = projection.fold_of(pos, n, p.folds)
            every = F.explode(F.sequence(F.lit(0), F.lit(p.folds - 1))).alias("held")
            rows = self.benign(PARTITIONS[1]).select("client_id", "epoch", "score", own.alias("own"), every)
            return ranks.marginal_ranks(rows, rows.filter("own <> held"), p.rank_epsilon, ("held", "client_id"))

        def cells_of() -> DataFrame:
            rows = self.stage("crossfit-ranks", ranks_of).withColumn("available", F.lit(True))
            panel = coalitions.epoch_panel(rows, self.client_ids(), ["held"], p.outside_lag, ("own",))
            binned = contexts.federation_bins(panel, p.histogram_bins)
            keys = ["held", "own", "_bins", "_counts", "_n"]
            wide = coalitions.coalition_epochs(binned, keys, self.client_ids(), order, p.outside_minimum, p.outside_fraction)
            hist = contexts.exact_histogram(F.col("idx"), F.col("_bins"), F.col("_counts"), F.col("avail"), F.col("_n"))
            rows = wide.filter("active").select("held", "own", "coalition_id", "ord", "epoch", "u", hist.alias("hist"))
            rows = self.stage(f"crossfit-rows-{check}", lambda: rows)
            train = rows.filter("own <> held").select("held", "ord", "hist")
            centroids = self.stage(f"crossfit-centroids-{check}", lambda: self._kmeans(train, by))
            found = contexts.assign_cells(rows, centroids, p.tie_tolerance, by)
            # a variant of a coalition is a coalition of its own from here on
            name = F.concat_ws("#", F.col("held").cast("string"), "coalition_id")
            return found.withColumn("coalition_id", name).drop("hist")

        def build() -> DataFrame:
            rows = self.stage(f"crossfit-cells-{check}", cells_of)
            train = F.col("own") != F.col("held")
            ok = contexts.cell_support(rows.filter(train), p.support_minima).filter("supported").select("coalition_id", "cell")
            rows = rows.join(ok, ["coalition_id", "cell"], "left_semi")
            table = self.stage(f"crossfit-table-{check}", lambda: ranks.conditional_rank_table(rows, train))
            ranked = self.stage(
                f"crossfit-ranked-{check}", lambda: ranks.conditional_ranks(rows, table, order, p.rank_epsilon)
            )
            folded = projection.with_folds(ranked.filter(train).select("coalition_id", "ord", "cell", "epoch", "r"), p.folds)
            fits = projection.fit_projections(folded, size, candidates, p.folds, p.tie_tolerance, p.svd_cutoff)
            final = fits.filter(F.col("fold") == projection.COMPLETE).select("coalition_id", "cell", "coef")
            held = ranked.filter(~train).join(final, ["coalition_id", "cell"])
            parts = F.split("coalition_id", "#")
            return held.select(
                F.get(parts, F.lit(1)).alias("coalition_id"), "ord", "cell", F.col("held").alias("fold"), "epoch",
                projection.residual(F.col("r"), F.col("coef"), size).alias("z"),
            )

        return self.stage(f"cross-fitted-{check}", build)

    # -- local policies -------------------------------------------------------------------------

    def policy_thresholds(self) -> DataFrame:
        return self.stage(
            "policy-thresholds", lambda: policy.candidate_thresholds(self.benign(PARTITIONS[1]), self.p.policy_quantiles)
        )

    def policy_counts(self, partition: str) -> DataFrame:
        rows = self.horizons(self.scores(), partition).join(self.policy_thresholds(), "client_id")
        stops = policy.local_stops(rows, ["client_id", "q_index", "horizon_id"], "h_pos", self.p.persistence)
        distinct = stops.select("client_id", "threshold", "m", "n", "horizon_id", "stop").distinct()
        return policy.false_stops(distinct)

    def policies(self) -> DataFrame:
        p = self.p
        return self.stage(
            "policies", lambda: policy.choose_policy(self.policy_counts(PARTITIONS[2]), p.confidence, p.pfa_target)
        )

    def heldout_stops(self) -> DataFrame:
        rows = self.horizons(self.scores(), PARTITIONS[3])
        return policy.policy_stops(rows, self.policies(), ["client_id", "horizon_id"], "h_pos", self.p.persistence)

    def campaign_local_stops(self) -> DataFrame:
        frame = campaigns.replay_frame(self.registry(), self.p.horizon, 0)
        rows = self.scores().filter("stream = 'all'").join(frame, "epoch")
        return policy.policy_stops(rows, self.policies(), ["client_id", "checksum"], "c_pos", self.p.persistence)

    # -- comparators ----------------------------------------------------------------------------

    def fusion(self) -> DataFrame:
        return comparators.rank_fusion(self.ranks(), ["stream", "epoch", "partition", "part_pos", "part_size"])

    def fusion_evidence(self, value: str = "mean_rank") -> DataFrame:
        p = self.p
        rows = self.fusion()
        reference = rows.filter((F.col("stream") == "benign") & (F.col("partition") == PARTITIONS[1]))
        return comparators.common_calibration(
            rows, reference, [], value, p.norm_quantile, p.scale_floor, p.norm_floor, p.clip_bound, p.bet
        )
