"""End-to-end plans built from the operators.

`Stages` gives each step of a pipeline as a lazy plan (``*_plan``) and, where
several later steps read it, as a stage table written once in the shared folder.
A query that reads a step once uses the plan, so Catalyst prunes what it does
not need down to the source scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.geo import epoch_us
from tidewater.operators import features as feat
from tidewater.operators import portcalls, sessions, spatial, voyages, weather
from tidewater.operators.ordered import DAY_US, HOT_BUCKET_ROWS, has_heavy_key, hot_key_widths
from tidewater.session import checked_count, delete_path, input_mark, path_exists, prepare, write_stage
from tidewater.sources import fixtures

RADIUS_NM = 10.0
MAX_SPEED_KNOTS = 1.5
GAP_THRESHOLD_H = 24.0
MIN_TIME_IN_PORT_H = 1.0


@dataclass
class Stages:
    """``keep_dir``: a folder in which stage tables are kept and reused by later runs
    over the same input and settings (S4): they lie under a mark of the input files, so a
    changed input gets new ones, and voyages and labelled pings are reused together or
    not at all. Without it every run writes its own."""
    spark: SparkSession
    sf_dir: str | None = None
    pings_df: DataFrame | None = None     # overrides the fixture pings (loaded files, stream buffer)
    ports_df: DataFrame | None = None     # overrides the fixture ports
    weather_df: tuple[DataFrame, DataFrame, DataFrame] | None = None  # marine, wind, port weather
    radius_nm: float = RADIUS_NM
    max_speed_knots: float = MAX_SPEED_KNOTS
    gap_threshold_h: float = GAP_THRESHOLD_H
    keep_dir: str | None = None
    _cache: dict = field(default_factory=dict)

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return write_stage(df, name, self._kept)

    @property
    def _kept(self) -> str | None:
        """The folder of the kept tables; at its first use, one of a run that did not get to its end is emptied."""
        if self.keep_dir is None or self.sf_dir is None:  # frames at hand have no files to mark
            return self.keep_dir

        def build():
            mark = input_mark(self.spark, [f"{self.sf_dir}/{t}.parquet" for t in ("events", "nation", "region")],
                              self.radius_nm, self.max_speed_knots, self.gap_threshold_h)
            root = f"{self.keep_dir.rstrip('/')}/{mark}"
            if not all(path_exists(self.spark, f"{root}/{t}/_SUCCESS") for t in ("voyages", "labeled")):
                for t in ("voyages", "labeled"):
                    delete_path(self.spark, f"{root}/{t}")
            return root
        return self._get("kept", build)

    # inputs
    @property
    def pings(self) -> DataFrame:
        return self._get("pings", lambda: self.pings_df if self.pings_df is not None
                         else fixtures.pings(prepare(self.spark), self.sf_dir))

    @property
    def ports(self) -> DataFrame:
        return self._get("ports", lambda: self.ports_df if self.ports_df is not None
                         else fixtures.ports(prepare(self.spark), self.sf_dir))

    # L1
    @property
    def candidates(self) -> DataFrame:
        return self._get("candidates", lambda: spatial.find_candidates(
            self.pings, self.ports, self.radius_nm, self.max_speed_knots))

    @property
    def visits_plan(self) -> DataFrame:
        return self._get("visits_plan", lambda: sessions.visits_from_candidates(self.candidates, self.gap_threshold_h))

    @property
    def visits(self) -> DataFrame:
        return self._get("visits", lambda: self.stage(self.visits_plan, "visits"))

    @property
    def voyages_base(self) -> DataFrame:
        return self._get("voyages_base", lambda: self.stage(voyages.voyages_from_visits(self.visits), "voyages"))

    @property
    def labeled_plan(self) -> DataFrame:
        return self._get("labeled_plan", lambda: voyages.label_pings(self.pings, self.visits, self.voyages_base))

    @property
    def labeled(self) -> DataFrame:
        return self._get("labeled", lambda: self.stage(self.labeled_plan, "labeled"))

    @property
    def voyages(self) -> DataFrame:
        return self._get("voyages", lambda: voyages.count_voyage_pings(self.voyages_base, self.labeled_plan))

    # L2
    @property
    def sea_plan(self) -> DataFrame:
        return self._get("sea_plan", lambda: feat.attach_arrival(feat.sea_pings(self.labeled_plan), self.voyages_base))

    @property
    def sea(self) -> DataFrame:
        """Sea pings, for steps that read them more than once."""
        return self._get("sea", lambda: self.stage(self.sea_plan, "sea"))

    @property
    def features_plan(self) -> DataFrame:
        def build():
            if not has_heavy_key(self.sea, "mmsi"):
                return feat.build_features(self.sea, self.ports, staged=True, by_key=True)
            widths = None
            if checked_count(self.sea) > HOT_BUCKET_ROWS:  # else no vessel can be hot
                t = self.sea.select("mmsi", epoch_us(F.col("base_date_time")).alias("_t"))
                widths = hot_key_widths(t, "mmsi", "_t", DAY_US)
            return feat.build_features(self.sea, self.ports, widths=widths, staged=True)
        return self._get("features_plan", build)

    @property
    def features(self) -> DataFrame:
        return self._get("features", lambda: self.stage(self.features_plan, "features"))

    @property
    def training(self) -> DataFrame:
        return self._get("training", lambda: feat.training_set(self.features))

    # L4
    def _weather(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        if self.weather_df is not None:
            return self.weather_df
        marine, wind = fixtures.cell_weather(keyed)
        return marine, wind, fixtures.port_weather(keyed, self.ports)

    def enriched_plan(self, parts: tuple[str, ...] = weather.PARTS) -> DataFrame:
        """Sea pings with the label, cell keys and the asked-for weather joins
        (of ``weather.PARTS``) and derived columns. The sea pings are a stage
        table when the fixture weather is derived from their keys."""
        keyed = weather.add_cell_keys(feat.remaining_travel(self.sea if parts else self.sea_plan))
        frames = dict(zip(weather.PARTS, self._weather(keyed))) if parts else {}
        return weather.enrich(keyed, {p: frames[p] for p in parts})

    def enriched(self, *cols: str) -> DataFrame:
        """The enriched columns that an analysis reads several times, as a stage table."""
        return self.stage(self.enriched_plan().select(*cols), "enriched")

    # L5
    @property
    def port_hours(self) -> DataFrame:
        return self._get("port_hours", lambda: portcalls.hours_in_port(
            portcalls.ports_left_join(self.pings, self.ports), n_rows=checked_count(self.pings)))

    @property
    def port_call_candidates(self) -> DataFrame:
        return self._get("pcc", lambda: portcalls.port_call_candidates(self.port_hours))
