"""Named queries over the test-data tables, grouped by area."""

from importlib import import_module

AREAS = ("a_consensus", "b_rating", "c_temporal", "d_campaign", "e_raster", "f_context", "g_cloud", "h_tracking", "i_evaluation", "j_annotations", "k_live", "s_sources")

for _area in AREAS:
    import_module(f"{__name__}.{_area}")
