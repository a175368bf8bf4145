"""Sources of master sheets, cameras and frames."""
