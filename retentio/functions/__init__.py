"""Column expressions (JVM-side, codegen'd): binning, feature formulas, link parsing."""

from retentio.functions.bins import (  # noqa: F401
    AGE_GROUPS,
    CHANGE_CATEGORIES,
    CHANGE_CLASSES,
    EXTREME_RISK,
    RISK_LEVELS,
    absence_rate,
    age_group,
    bin_rank,
    change_category,
    change_class3,
    clean_double,
    faculty_year,
    low_performance,
    right_closed_bins,
    risk_level,
    risk_rank,
)
from retentio.functions.links import drive_file_id, dropbox_direct, onedrive_download, url_file_name  # noqa: F401
