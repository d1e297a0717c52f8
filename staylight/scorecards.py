"""Fixed scorecards: scoring without a fitted model, and a yardstick for checks."""

from __future__ import annotations

from staylight.operators.scoring import Scorecard

ACCOUNT_SCORECARD = Scorecard(
    label="Account scorecard",
    intercept=-0.35,
    points={
        "tier": {"Entry": 0.42, "Junior": 0.21, "Mid": 0.03, "Senior": -0.17, "Executive": -0.31},
        "urgent": {"No": -0.12, "Yes": 0.23},
        "returns": {"None": -0.11, "Rare": 0.04, "Frequent": 0.29},
        "discount": {"None": 0.26, "Basic": 0.07, "Standard": -0.09, "Premium": -0.22},
        "fulfilment": {"Low": 0.37, "Medium": 0.13, "High": -0.08, "Very High": -0.34},
        "segment": {"AUTOMOBILE": 0.06, "BUILDING": -0.05, "FURNITURE": 0.02},
        "tenure_band": {"2-5 years": 0.18, "5-10 years": -0.07},
    },
    slopes={
        "monthly_spend": (21000.0, 9000.0, -0.33),
        "tenure_years": (5.0, 0.9, -0.19),
        "recency_years": (0.7, 0.6, 0.71),
        "orders_n": (9.0, 3.0, -0.24),
        "orders_last_year": (1.5, 1.2, -0.45),
        "suppliers_n": (32.0, 9.0, -0.08),
        "promotion_gap": (0.15, 0.2, 0.14),
        "pay_per_level": (9000.0, 7000.0, -0.06),
    },
)

HR_SCORECARD = Scorecard(
    label="HR scorecard",
    intercept=-0.5,
    points={
        "OverTime": {"No": -0.3, "Yes": 0.8},
        "JobLevel": {"Entry": 0.5, "Junior": 0.2, "Mid": 0.0, "Senior": -0.3, "Executive": -0.4},
        "BusinessTravel": {"None": -0.4, "Rare": 0.0, "Frequent": 0.5},
        "StockOptionLevel": {"None": 0.4, "Basic": -0.1, "Standard": -0.2, "Premium": -0.3},
        "JobSatisfaction": {"Low": 0.4, "Medium": 0.1, "High": -0.1, "Very High": -0.3},
        "EnvironmentSatisfaction": {"Low": 0.4, "Medium": 0.1, "High": -0.1, "Very High": -0.2},
        "WorkLifeBalance": {"Low": 0.3, "Medium": 0.1, "High": -0.1, "Very High": -0.2},
        "JobInvolvement": {"Low": 0.4, "Medium": 0.1, "High": -0.1, "Very High": -0.2},
        "MaritalStatus": {"Divorced": -0.2, "Married": -0.1, "Single": 0.3},
        "TenureBand": {"Under 2 years": 0.4, "2-5 years": 0.1, "5-10 years": -0.1, "10+ years": -0.4},
    },
    slopes={
        "Age": (36.0, 9.0, -0.2),
        "MonthlyIncome": (110000.0, 80000.0, -0.3),
        "DistanceFromHome": (9.0, 8.0, 0.2),
        "PromotionGap": (0.4, 0.5, 0.1),
    },
)
