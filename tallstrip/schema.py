"""Row types of the tables that plans exchange, as DDL."""

from __future__ import annotations

PAGES = "chapter_id string, page_no int, width int, height int, n_channels int, data binary"
BANDS = "chapter_id string, band_no int, y0 int, y1 int, halo_top int, halo_bottom int, width int, n_channels int, data binary"
PIXELS = "img bigint, y int, x int, r int, g int, b int, a int"
RUNS = "img bigint, y int, x0 int, x1 int"
ROW_PROFILE = "img bigint, y int, n bigint"
SEGMENTS = "img bigint, idx int, y0 int, y1 int, height int, reason string"
COMPONENTS = "img bigint, comp bigint, x int, y int, w int, h int, area bigint, cx double, cy double"
SCORES = "rank int, chapter string, estimated_success_percent double, priority_score double, damage_percent_deleted double, damage_percent_total double, delete_percent_total double, leftover_grayline_percent_total double, total_pixels bigint, deleted_pixels bigint, damaged_pixels bigint, leftover_grayline_pixels bigint, width int, height int, original_path string, result_path string"
PAIRS = "episode string, variant string, page string, src string, target string"
STRATA = "w int, h int, low_texture array<array<int>>, boundary array<array<int>>"
MODEL_CONFIG = "model_type string, in_channels int, base_channels int, patch_size int, threshold double, alpha_threshold int, threshold_value int, morph_radius int, sdt_head boolean, sdt_clamp_radius int"
