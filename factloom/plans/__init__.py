from .algebra import Measure, Plan, PlanError, analyze, run
