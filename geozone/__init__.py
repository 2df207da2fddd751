"""Analytics over zones on Spark: local and global aggregation, routing, placement and work lists."""

from geozone.operators.aggregate import global_agg, local_and_global, local_result, zone_local_agg
from geozone.operators.assign import (
    assign_group,
    assign_slots,
    assign_zone_even,
    assign_zone_quota,
    expand_ranges,
    first_slot_per_host,
    spread_rest,
    unassigned,
)
from geozone.operators.ordinal import ordinal
from geozone.operators.placement import (
    best_zone,
    best_zone_overall,
    classify_members,
    find_levels,
    group_dependencies,
    place_in_order,
)
from geozone.operators.routing import (
    colocate,
    colocate_zones,
    eligible_targets,
    route_by_key,
    route_random,
    target_lists,
)
from geozone.operators.tagging import latency_as_of, latency_of, member_zone, observed_latency, tag_zones, zone_names
from geozone.session import clear_scratch
from geozone.sources.latency_matrix import parse_latency_matrix, read_latency_matrices, write_latency_matrix
from geozone.sources.lines import as_lines, read_lines
from geozone.sources.report import placement_report, report_lines, write_placement_report
from geozone.sources.settings import member_settings, settings_from_json
from geozone.sources.source_zones import parse_source_zones, read_source_zones, write_source_zones
from geozone.sources.zone_members import parse_zone_members, read_zone_members, write_zone_members, zone_members
from geozone.streaming.aggregate import (
    compact_versions,
    corrected_rows,
    latest_versions,
    local_rows,
    start_append,
    start_corrected,
    start_versions,
    stream_global_agg,
    stream_partial,
    stream_result,
    stream_zone_local_agg,
)
from geozone.streaming.members import current_lines, current_members, start_zone_members
from geozone.streaming.routing import newest_lists, publish_lists, read_lists, route_stream, routed_rows, start_route_live

__all__ = [name for name in dir() if not name.startswith("_")]
