"""Ordered field lists of the geometry blocks and explicit schemas of text sources."""

# --- Fixed values: block fields in their published order ---
BEFORE_FIELDS = """
artwork_id source_filename source_width_px source_height_px source_aspect_ratio
source_orientation source_has_alpha source_background_type source_bbox_x source_bbox_y
source_bbox_width source_bbox_height source_padding_left source_padding_right
source_padding_top source_padding_bottom source_center_x_pct source_center_y_pct
reconstruction_mode print_method print_location garment_style garment_color
target_print_width_in target_print_height_in target_dpi target_width_px target_height_px
target_aspect_ratio aspect_ratio_policy max_ratio_variance_pct crop_allowed
stretch_allowed reposition_allowed background_requirement max_transparent_margin_in
white_elements_policy black_elements_policy semi_transparency_allowed
semi_transparency_types distress_present distress_policy text_present
text_must_match_exactly object_count text_region_count important_object_geometry
generation_prompt_version dtf_profile_id
""".split()

AFTER_FIELDS = """
output_width_px output_height_px output_aspect_ratio output_orientation output_has_alpha
effective_dpi_x effective_dpi_y output_bbox_x output_bbox_y output_bbox_width
output_bbox_height padding_left padding_right padding_top padding_bottom padding_left_in
padding_right_in padding_top_in padding_bottom_in output_center_x_pct output_center_y_pct
alpha_zero_count alpha_1_10_count alpha_11_50_count alpha_51_200_count
alpha_201_254_count alpha_255_count low_alpha_outside_intent_count
semi_transparent_inside_effects_count edge_pixel_count edge_contamination_count
edge_contamination_pct halo_white_px halo_dark_px fringe_pixel_count
connected_component_count isolated_component_count micro_component_count
smallest_component_area_px minimum_line_width_px minimum_line_width_in
minimum_text_stroke_px minimum_hole_size_px distance_left_edge_px
distance_right_edge_px distance_top_edge_px distance_bottom_edge_px clipping_detected
source_ratio_difference_pct bbox_similarity_pct object_position_similarity_pct
object_scale_similarity_pct text_geometry_similarity_pct overall_geometry_similarity_pct
text_ocr_match_pct semantic_similarity_pct missing_objects_count extra_objects_count
background_transparency_status resolution_status geometry_status alpha_status
halo_status stray_pixel_status fine_detail_status clipping_status text_status
semantic_status overall_qa_status
""".split()

AUTOFIX_FIELDS = """
autofix_required autofix_count autofix_trim_padding autofix_remove_strays
autofix_clean_halo autofix_alpha_cleanup autofix_resize autofix_upscale
autofix_strengthen_details qa_rerun_required qa_rerun_count final_after_autofix_status
""".split()

APPROVAL_FIELDS = """
approved_version_id customer_approved approval_timestamp approved_print_width_in
approved_print_height_in approved_file_hash production_locked final_machine_qa_status
production_master_version artwork_vault_status gangsheet_ready
""".split()

DIAG_ENTRY = (
    "ts double, time string, kind string, username string, agent_name string, agent_id string, "
    "code_version string, job_id string, workflow string, step string, exc_type string, "
    "message string, traceback string, detail string"
)
