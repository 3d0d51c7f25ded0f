"""Jobs over words, detections, folders, drafts and frames."""
