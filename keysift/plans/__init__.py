from keysift.plans.scan import (after_scan, archive_errors, archive_metrics, files_scanned, layer_reuse, scan_archives,
                                scan_archives_distinct, scan_composite, scan_files, scan_image_files, scan_roots, scan_table)

__all__ = ["after_scan", "archive_errors", "archive_metrics", "files_scanned", "layer_reuse", "scan_archives",
           "scan_archives_distinct", "scan_composite", "scan_files", "scan_image_files", "scan_roots", "scan_table"]
