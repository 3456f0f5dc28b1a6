"""Column-expression functions (all JVM-side built-ins)."""

from .addresses import ipv6_prefix48, is_ipv4, is_ipv6, mask_ip
from .cells import Grid, crosses_antimeridian, ring_bounds
from .clock import age_unit, as_of_latest, in_window, now_ms, recent_age, relative_age, round_half_up, window_cut
from .labels import china_facility_name, display_label, split_part, territory_type_of_id, wikidata_link
from .names import name_colour, name_hash24, valid_name

__all__ = [
    "Grid", "age_unit", "as_of_latest", "china_facility_name", "crosses_antimeridian", "display_label",
    "in_window", "ipv6_prefix48", "is_ipv4", "is_ipv6", "mask_ip", "name_colour", "name_hash24", "now_ms",
    "recent_age", "relative_age", "ring_bounds", "round_half_up", "split_part", "territory_type_of_id",
    "valid_name", "wikidata_link", "window_cut",
]
