"""A C subset front end in plain Python: functions, flow graphs, data flow, facts. One Arrow pass for each file."""
