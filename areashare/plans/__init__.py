from areashare.plans.report import DOAC_SHARE, ShareReport, share_report

__all__ = ["DOAC_SHARE", "ShareReport", "share_report"]
