from keysift.sources.archives import expand_archives, expand_layers, layer_manifest, one_place_each
from keysift.sources.files import files_as_text, read_files, read_text_table, skipped_files, skipped_image_files
from keysift.sources.published import Conflict, Published
from keysift.sources.staging import Staging, materialized, materialized_together, shared_folder

__all__ = ["Conflict", "expand_archives", "expand_layers", "files_as_text", "layer_manifest", "materialized", "materialized_together", "one_place_each", "Published",
           "read_files", "read_text_table", "shared_folder", "skipped_files", "skipped_image_files", "Staging"]
