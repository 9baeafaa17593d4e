"""What users call: reads, what-if scoring and the monitoring job in one place.

==============================  =======================================================
latest risk of every zone       ``latest_risk(snapshots, zones, domains)``
history of a zone               ``zone_history(snapshots, zone_id, start, end)``
latest payload of a source      ``latest_payload(raw, [source])``
payload behind a file name      ``payload_for_file(raw, filename)``
newest alerts                   ``recent_alerts(raw, n)``
what-if scenarios               ``simulate(zones, scenarios)``
features of a GeoJSON layer     ``read_geojson(spark, path)``, ``read_layers(spark, path)``
land and score topics           ``run_monitor(spark, config, once)``
upkeep of landed tables         ``compact_closed(spark, path, before)``, ``expire_closed(spark, path, grace)``
==============================  =======================================================
"""

from floodlens.operators.latest import (  # noqa: F401
    latest_payload, latest_risk, payload_for_file, recent_alerts, zone_history,
)
from floodlens.operators.nearest import nearest_place  # noqa: F401
from floodlens.operators.scoring import (  # noqa: F401
    Scenario, city_gauge, current_conditions, score_zones, simulate, split_scenarios, validate_scenarios,
)
from floodlens.operators.series import bracket, interpolate, tide_with_fallback  # noqa: F401
from floodlens.session import build_session  # noqa: F401
from floodlens.sources.layers import read_geojson, read_layers  # noqa: F401
from floodlens.sources.sinks import compact_closed, expire_closed, read_landed, read_snapshots  # noqa: F401
from floodlens.sources.zones import read_zones  # noqa: F401
from floodlens.streaming.landing import MonitorConfig, run_monitor  # noqa: F401
