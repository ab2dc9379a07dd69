"""Named regions: a name stands for ranges of some columns.

Names are resolved on the driver, before planning, into plain ranges. The tables are available as DataFrames too, for
questions over many regions at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rangeloom.plans.model import QueryError, Range

Box = dict[str, tuple[float, float]]

# Name, latitude from and to, longitude from and to.
CALIFORNIA = """
San Francisco | 37.70 37.92 -122.55 -122.33
Los Angeles | 33.50 34.50 -119.00 -117.50
San Diego | 32.50 33.20 -117.50 -116.50
Sacramento | 38.30 38.80 -121.70 -121.10
San Jose | 37.20 37.50 -122.10 -121.70
Oakland | 37.70 37.90 -122.35 -122.10
Berkeley | 37.83 37.92 -122.35 -122.22
Fresno | 36.60 37.00 -120.00 -119.50
Long Beach | 33.70 33.90 -118.30 -118.00
Santa Barbara | 34.30 34.60 -120.20 -119.50
Monterey | 36.50 36.70 -122.00 -121.70
Bakersfield | 35.20 35.60 -119.20 -118.80
Stockton | 37.80 38.10 -121.50 -121.10
Riverside | 33.80 34.10 -117.60 -117.20
Anaheim | 33.75 33.90 -118.00 -117.70
Santa Rosa | 38.35 38.60 -122.85 -122.50
Oxnard | 34.10 34.30 -119.30 -119.00
Irvine | 33.60 33.75 -117.90 -117.70
Chula Vista | 32.55 32.70 -117.15 -116.95
Modesto | 37.55 37.75 -121.10 -120.80
Silicon Valley | 37.20 37.60 -122.20 -121.70
Palo Alto | 37.38 37.48 -122.18 -122.07
Sunnyvale | 37.33 37.42 -122.08 -121.97
Mountain View | 37.35 37.43 -122.13 -122.00
Cupertino | 37.28 37.35 -122.10 -121.97
Santa Monica | 34.00 34.05 -118.52 -118.44
Beverly Hills | 34.05 34.10 -118.43 -118.37
Malibu | 34.00 34.10 -118.95 -118.60
Bay Area | 37.00 38.50 -123.00 -121.00
LA Metro | 33.50 34.50 -119.00 -117.50
SF Metro | 37.40 37.90 -122.60 -121.80
Central Valley | 35.00 39.00 -121.50 -118.50
Coastal SoCal | 32.50 34.50 -119.00 -117.00
Coastal NorCal | 37.50 41.95 -124.35 -122.00
Northern CA | 38.50 41.95 -124.35 -114.31
Southern CA | 32.54 36.00 -121.00 -114.31
Inland Empire | 33.60 34.30 -117.70 -116.50
Orange County | 33.40 33.95 -118.10 -117.40
Wine Country | 38.00 39.00 -123.50 -122.00
Gold Country | 37.50 39.50 -121.00 -119.50
"""

# Name, latitude from and to, longitude from and to.
NEW_YORK = """
Manhattan | 40.700 40.882 -74.020 -73.907
Brooklyn | 40.570 40.740 -74.042 -73.833
Queens | 40.541 40.800 -73.962 -73.700
Bronx | 40.785 40.917 -73.933 -73.748
Staten Island | 40.477 40.651 -74.259 -74.034
Midtown | 40.748 40.768 -74.000 -73.970
Lower Manhattan | 40.700 40.720 -74.020 -73.990
Upper East Side | 40.762 40.785 -73.965 -73.942
Upper West Side | 40.762 40.800 -73.995 -73.970
Harlem | 40.800 40.830 -73.960 -73.920
East Village | 40.720 40.733 -73.995 -73.975
West Village | 40.730 40.742 -74.010 -73.998
SoHo | 40.720 40.730 -74.007 -73.993
Tribeca | 40.714 40.724 -74.015 -74.000
Chelsea | 40.740 40.752 -74.005 -73.990
Hell's Kitchen | 40.752 40.768 -74.005 -73.988
Financial District | 40.700 40.712 -74.020 -74.000
Chinatown | 40.713 40.720 -74.002 -73.993
Gramercy | 40.733 40.745 -73.990 -73.978
Murray Hill | 40.745 40.753 -73.985 -73.970
Flatiron | 40.738 40.745 -73.993 -73.985
Morningside Heights | 40.800 40.815 -73.968 -73.950
Washington Heights | 40.833 40.868 -73.950 -73.920
Inwood | 40.865 40.882 -73.940 -73.910
Williamsburg | 40.700 40.720 -73.975 -73.940
Brooklyn Heights | 40.692 40.702 -74.002 -73.990
Park Slope | 40.660 40.678 -73.990 -73.975
Bushwick | 40.693 40.713 -73.935 -73.905
Bed-Stuy | 40.676 40.695 -73.960 -73.920
Crown Heights | 40.659 40.678 -73.955 -73.930
Sunset Park | 40.634 40.655 -74.010 -73.985
Bay Ridge | 40.615 40.640 -74.042 -74.010
Coney Island | 40.570 40.585 -74.010 -73.980
DUMBO | 40.700 40.706 -73.995 -73.985
Flatbush | 40.627 40.648 -73.965 -73.940
Greenpoint | 40.720 40.735 -73.960 -73.940
Astoria | 40.765 40.785 -73.940 -73.910
Long Island City | 40.742 40.760 -73.955 -73.930
Flushing | 40.755 40.775 -73.840 -73.810
Jackson Heights | 40.745 40.760 -73.895 -73.870
Jamaica | 40.685 40.710 -73.820 -73.780
JFK Airport | 40.615 40.650 -73.820 -73.760
South Bronx | 40.790 40.820 -73.933 -73.895
Fordham | 40.855 40.870 -73.910 -73.885
Riverdale | 40.883 40.905 -73.925 -73.897
"""

# Name, elevation from and to, slope from and to.
FOREST_ZONES = """
Krummholz | 3400 3858 20 90
HighAlpine | 3200 3858 15 90
Subalpine | 2800 3200 8 22
Montane | 2400 2800 5 18
Lowland | 1863 2400 0 12
Riparian | 1863 2200 0 8
"""


def _boxes(table: str, *columns: str) -> dict[str, Box]:
    out = {}
    for line in table.strip().splitlines():
        name, _, numbers = line.partition(" | ")
        values = list(map(float, numbers.split()))
        out[name] = {c: (values[2 * k], values[2 * k + 1]) for k, c in enumerate(columns)}
    return out


@dataclass(frozen=True)
class Lookup:
    """One kind of region. ``partial``: a unique part of a name will do. ``every``: all of its columns must exist."""

    kind: str
    boxes: dict[str, Box]
    partial: bool = True
    every: bool = True
    aliases: tuple[str, ...] = ()

    def find(self, name: str) -> str:
        wanted = name.strip().lower()
        exact = [n for n in self.boxes if n.lower() == wanted]
        if exact:
            return exact[0]
        close = [n for n in self.boxes if self.partial and wanted and wanted in n.lower()]
        if len(close) == 1:
            return close[0]
        if close:
            raise QueryError(f"{self.kind} {name!r} is ambiguous: {', '.join(close)}")
        raise QueryError(f"unknown {self.kind} {name!r}; known: {', '.join(self.boxes)}")


#: Rows of regions that the driver holds.
LOOKUP_ROWS = 100_000


@dataclass
class LookupRegistry:
    """The kinds of region that queries may name."""

    lookups: dict[str, Lookup] = field(default_factory=dict)
    resolvers: dict[str, Callable[[str], Box]] = field(default_factory=dict)

    def register(self, lookup: Lookup) -> None:
        for word in (lookup.kind, *lookup.aliases):
            self.lookups[word.lower()] = lookup

    def register_frame(self, kind: str, df: DataFrame, partial: bool = True) -> None:
        """Register the rows (name, column, lo, hi) of a DataFrame of at most LOOKUP_ROWS rows; more of them are refused."""
        found = df.select("name", "column", "lo", "hi").orderBy("name", "column").limit(LOOKUP_ROWS + 1).collect()
        if len(found) > LOOKUP_ROWS:
            raise QueryError(f"more than {LOOKUP_ROWS} rows of regions: join them as a table instead")
        boxes: dict[str, Box] = {}
        for r in found:
            boxes.setdefault(r["name"], {})[r["column"]] = (float(r["lo"]), float(r["hi"]))
        self.register(Lookup(kind, boxes, partial))

    def kind(self, word: str) -> Lookup | None:
        return self.lookups.get(word.lower())

    def ranges(self, word: str, name: str, columns: Sequence[str]) -> dict[str, Range]:
        """The ranges of a region over a table's columns."""
        lookup = self.kind(word)
        if lookup is None:
            raise QueryError(f"unknown kind of region {word!r}")
        box, own = lookup.boxes[lookup.find(name)], {c.lower(): c for c in columns}
        missing = [c for c in box if c.lower() not in own]
        if missing and (lookup.every or len(missing) == len(box)):
            raise QueryError(f"{lookup.kind} needs the column {', '.join(missing)}")
        return {own[c.lower()]: Range(*r) for c, r in box.items() if c.lower() in own}

    def frame(self, spark: SparkSession) -> DataFrame:
        """All regions as rows (kind, name, column, lo, hi)."""
        rows: list[tuple] = []
        for lookup in {id(x): x for x in self.lookups.values()}.values():
            rows += [(lookup.kind, n, c, lo, hi) for n, box in lookup.boxes.items() for c, (lo, hi) in box.items()]
        return spark.createDataFrame(rows, "kind string, name string, column string, lo double, hi double")


def default_registry() -> LookupRegistry:
    """Places of California, neighbourhoods of New York and forest zones."""
    out = LookupRegistry()
    out.register(Lookup("place", _boxes(CALIFORNIA, "Latitude", "Longitude"), aliases=("places",)))
    out.register(Lookup("neighbourhood", _boxes(NEW_YORK, "Latitude", "Longitude"), aliases=("neighbourhoods",)))
    out.register(Lookup("zone", _boxes(FOREST_ZONES, "Elevation", "Slope"), partial=False, every=False, aliases=("zones",)))
    return out
