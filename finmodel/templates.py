"""Ready-made groups of definitions. Each takes a model that has the inputs named, and returns it."""

from __future__ import annotations

from .model import FinancialModel


def _define(model: FinancialModel, **formulas: str) -> FinancialModel:
    for name, formula in formulas.items():
        model.define(name, formula)
    return model


def income_statement(model: FinancialModel) -> FinancialModel:
    """Inputs revenue, cogs, opex."""
    return _define(model, gross_profit="revenue - cogs", gross_margin="gross_profit / revenue", ebitda="gross_profit - opex", operating_margin="ebitda / revenue")


def operating_model(model: FinancialModel) -> FinancialModel:
    """Inputs revenue, cogs, opex, capex, tax, wc_change."""
    return _define(income_statement(model), free_cash_flow="free_cash_flow(ebitda, capex, tax, wc_change)")


def working_capital(model: FinancialModel) -> FinancialModel:
    """Inputs revenue, cogs, receivable_days, payable_days, inventory."""
    return _define(model, receivables="receivables(revenue, receivable_days)", payables="payables(cogs, payable_days)", net_working_capital="working_capital(receivables, inventory, payables)")


def dcf(model: FinancialModel, *, cashflow_series: str = "cashflows", rate: str = "discount_rate") -> FinancialModel:
    """A series of cash flows and a rate."""
    return _define(model, enterprise_value=f"npv({rate}, {cashflow_series})")


def return_risk(model: FinancialModel, *, series: str = "returns") -> FinancialModel:
    """A series of returns."""
    return _define(model, volatility=f"volatility({series})", value_at_risk=f"var({series})")


def saas(model: FinancialModel) -> FinancialModel:
    """Inputs arpu, gross_margin_pct, monthly_churn, cac."""
    return _define(model, lifetime_months="1 / monthly_churn", ltv="arpu * gross_margin_pct * lifetime_months", ltv_cac="ltv / cac")
