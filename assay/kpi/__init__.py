"""Industry detection, the KPI catalogue, and the KPIs as runnable DataFrame queries."""
