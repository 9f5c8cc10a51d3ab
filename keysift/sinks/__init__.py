from keysift.sinks.report import (Malformed, csv_rows, document_items, json_rows, listing, parsed_items, report_metrics,
                                  sarif_results, sarif_rules, severity_level, severity_score, write_csv, write_findings,
                                  write_json, write_jsonl, write_sarif)

__all__ = ["Malformed", "csv_rows", "document_items", "json_rows", "listing", "parsed_items", "report_metrics",
           "sarif_results", "sarif_rules", "severity_level", "severity_score", "write_csv", "write_findings",
           "write_json", "write_jsonl", "write_sarif"]
