"""The built-in prototype factors, by rule: a formula over placeholders, and what each name puts there.

Formulas are in the notation of ``formula``; signals are formulas with a name of their own. Every series
is one (instrument, date) in the order of ts_ms, a row every three seconds.
"""

from __future__ import annotations

from functools import cache

from quantloom.functions.formula import Node, parse, substitute

# Named signals.
SIGNALS = {
    "imb_full": "if((total_bid_vol + total_ask_vol) > 0, (total_bid_vol-total_ask_vol)/(total_bid_vol + total_ask_vol), null)",
    "imb5": "if((depth_bid5 + depth_ask5) > 0, (depth_bid5-depth_ask5)/(depth_bid5 + depth_ask5), null)",
    "imb1": "if((bid1_qty + ask1_qty) > 0, (bid1_qty-ask1_qty)/(bid1_qty + ask1_qty), null)",
    "hidden_bid": "if(total_bid_vol > depth_bid5, total_bid_vol-depth_bid5, 0)",
    "hidden_ask": "if(total_ask_vol > depth_ask5, total_ask_vol-depth_ask5, 0)",
    "conc_bid": "if(total_bid_vol > 0, depth_bid5/total_bid_vol, null)",
    "conc_ask": "if(total_ask_vol > 0, depth_ask5/total_ask_vol, null)",
    "lastgap": "(last_px-mid_px)/0.001",
    "opendev": "((mid_px-open_px)/open_px)*10000",
    "logrv60": "log(clip(rv_60s, 1e-20, 10000000000))",
    "logrv300": "log(clip(rv_300s, 1e-20, 10000000000))",
    "hidden_imb": "if((hidden_bid + hidden_ask) > 0, (hidden_bid-hidden_ask)/(hidden_bid + hidden_ask), null)",
    "hidden_bid_share": "if(total_bid_vol > 0, hidden_bid/total_bid_vol, null)",
    "hidden_ask_share": "if(total_ask_vol > 0, hidden_ask/total_ask_vol, null)",
    "visible_share": "if((total_bid_vol + total_ask_vol) > 0, (depth_bid5 + depth_ask5)/(total_bid_vol + total_ask_vol), null)",
    "rv60_regime": "if(notnull(mean100(rv_60s))&(mean100(rv_60s) > 0), rv_60s/mean100(rv_60s), null)",
    "ofi_concord": "sgn(ofi_15s)*(((abs(ofi_15s) + abs(ofi_60s))-abs((ofi_15s-ofi_60s)))/2)",
    "day_range": "cum_max(mid_px)-cum_min(mid_px)",
    "range_pos": "if(notnull(day_range)&(day_range > 1e-12), (mid_px-cum_min(mid_px))/day_range, null)",
    "wide": "clip(z100(quoted_spread_ticks), 0, null)",
    "imb_gap": "wdi-imb_full",
}

# Formula -> {prototype: what stands for x1, x2, ...}.
RULES: list[tuple[str, dict[str, str]]] = [
    (
        "z100(x1)",
        {
            "oir_z_300s": "oir",
            "book_slope_z_300s": "book_slope",
            "dev_open_z_300s": "opendev",
            "event_intens_z_300s": "book_event_intensity_60s",
            "fullbook_imb_z_300s": "imb_full",
            "hidden_ask_supply_z_300s": "hidden_ask_share",
            "hidden_bid_support_z_300s": "hidden_bid_share",
            "iopv_vel_z_300s": "iopv_velocity",
            "microprice_dev_z_300s": "microprice_dev",
            "rv_z_300s": "rv_300s",
            "top5_book_div_z_300s": "imb_gap",
            "trade_count_z_300s": "n_trades_60s",
            "visible_share_z_300s": "visible_share",
        },
    ),
    (
        "z100(x1) * z100(x2)",
        {
            "div_x_ofi_align": "imb_gap ofi_60s",
            "div_x_vis_share": "imb_gap visible_share",
            "div_z_x_spread_z": "imb_gap quoted_spread_ticks",
            "fbi_z_x_rv_z": "imb_full rv_60s",
            "gap_x_ti_align_300s": "lastgap trade_imbalance_60s",
            "hidden_ask_x_sellvol_z": "hidden_ask_share sell_vol_60s",
            "hidden_bid_x_buyvol_z": "hidden_bid_share buy_vol_60s",
            "iopv_velz_x_spread_z": "iopv_velocity quoted_spread_ticks",
            "micro_gap_confirm_300s": "microprice_dev lastgap",
            "open_dev_z_x_ofi_z": "opendev ofi_60s",
            "slope_x_ti_absorb_300s": "book_slope trade_imbalance_60s",
            "top5div_x_ofi_z": "imb_gap ofi_60s",
            "top5div_x_spread_z": "imb_gap quoted_spread_ticks",
        },
    ),
    (
        "delta5(delta5(z100(x1))) * abs(z100(x1))",
        {
            "depth5_imb_zaccel_extreme_15s": "imb5",
            "fullbook_imb_zaccel_extreme_15s": "imb_full",
            "lastgap_zaccel_extreme_15s": "lastgap",
            "ltns_zaccel_extreme_15s": "large_trade_net_share_60s",
            "microprice_dev_zaccel_extreme_15s": "microprice_dev",
            "n_trades_60s_zaccel_extreme_15s": "n_trades_60s",
            "ofi_15s_zaccel_extreme_15s": "ofi_15s",
            "ofi_30s_zaccel_extreme_15s": "ofi_30s",
            "ofi_60s_zaccel_extreme_15s": "ofi_60s",
            "oir_zaccel_extreme_15s": "oir",
            "ti60_zaccel_extreme_15s": "trade_imbalance_60s",
            "wdi_zaccel_extreme_15s": "wdi",
        },
    ),
    (
        "if(isnull(z100(x1)) | isnull(lag5(z100(x1))), null, if(((sgn(z100(x1)) != sgn(lag5(z100(x1)))) & (z100(x1) != 0)) & (lag5(z100(x1)) != 0), 1, 0)) * delta5(z100(x1))",
        {
            "event_int_z_cross_vel_15s": "book_event_intensity_60s",
            "fullbook_imb_z_cross_vel_15s": "imb_full",
            "iopv_prem_z_cross_vel_15s": "iopv_premium",
            "lastgap_z_cross_vel_15s": "lastgap",
            "ltns_z_cross_vel_15s": "large_trade_net_share_60s",
            "ofi_z_cross_vel_15s": "ofi_60s",
            "oir_z_cross_vel_15s": "oir",
            "rv60_logz_cross_vel_15s": "logrv60",
            "slope_z_cross_vel_15s": "book_slope",
            "spread_z_cross_vel_15s": "quoted_spread_ticks",
            "ti60_z_cross_vel_15s": "trade_imbalance_60s",
            "wdi_z_cross_vel_15s": "wdi",
        },
    ),
    (
        "delta20(x1)",
        {
            "depth5_delta_60s": "imb5",
            "book_slope_delta_60s": "book_slope",
            "fullbook_imb_mom_60s": "imb_full",
            "gap_vel_60s": "lastgap",
            "iopv_premium_mom_60s": "iopv_premium",
            "ltns_delta_60s": "large_trade_net_share_60s",
            "microprice_dev_mom_60s": "microprice_dev",
            "oir_mom_60s": "oir",
            "top5_book_div_mom_60s": "imb_gap",
            "vis_share_vel_60s": "visible_share",
        },
    ),
    (
        "delta5(z100(x1)) * abs(z100(x1))",
        {
            "depth5_imb_zvel_extreme_15s": "imb5",
            "lastgap_zvel_extreme_15s": "lastgap",
            "microprice_dev_zvel_extreme_15s": "microprice_dev",
            "n_trades_60s_zvel_extreme_15s": "n_trades_60s",
            "ofi_15s_zvel_extreme_15s": "ofi_15s",
            "ofi_30s_zvel_extreme_15s": "ofi_30s",
            "ofi_60s_zvel_extreme_15s": "ofi_60s",
            "rv60_logzvel_extreme_15s": "logrv60",
            "spread_zvel_extreme_15s": "quoted_spread_ticks",
            "wdi_zvel_extreme_15s": "wdi",
        },
    ),
    (
        "z100(x1) * x2",
        {
            "div_x_ti_align": "imb_gap trade_imbalance_60s",
            "hidden_ask_x_ltns_15s": "hidden_ask_share large_trade_net_share_60s",
            "hidden_bid_x_ltns_15s": "hidden_bid_share large_trade_net_share_60s",
            "iopv_vel_x_wdi": "iopv_velocity wdi",
            "iopv_velz_wide_gate": "iopv_velocity wide",
            "open_dev_z_x_ti_60s": "opendev trade_imbalance_60s",
            "top5div_spread_wide_gate": "imb_gap quoted_spread_ticks",
            "vis_hid_share_x_ofi_60s": "visible_share ofi_60s",
            "vis_share_x_ti": "visible_share trade_imbalance_60s",
        },
    ),
    (
        "z100(x1) * sgn(delta5(delta5(z100(x1))))",
        {
            "fullbook_imb_zaccel_x_15s": "imb_full",
            "lastgap_zaccel_x_15s": "lastgap",
            "ltns_zaccel_x_15s": "large_trade_net_share_60s",
            "microprice_dev_z_accel_sign_15s": "microprice_dev",
            "ofi_z_accel_sign_15s": "ofi_60s",
            "ti60_zaccel_x_15s": "trade_imbalance_60s",
        },
    ),
    (
        "x1",
        {
            "large_trade_share_level": "large_trade_share_60s",
            "dev_from_open_bps": "opendev",
            "last_mid_gap_ticks": "lastgap",
            "mid_day_range_pos": "range_pos",
            "ofi_concord_15_60": "ofi_concord",
        },
    ),
    (
        "z40(x1)",
        {
            "book_div_z_120s": "imb_gap",
            "iopv_premium_z_120s": "iopv_premium",
            "ofi_15s_z_120s": "ofi_15s",
            "spread_z_120s": "quoted_spread_ticks",
            "ti_15s_z_120s": "trade_imbalance_15s",
        },
    ),
    (
        "x1 * x2",
        {
            "dev_open_x_ti15": "opendev trade_imbalance_15s",
            "hidden_imb_x_ti": "hidden_imb trade_imbalance_60s",
            "lastgap_spread_wide_gate": "lastgap quoted_spread_ticks",
            "ltns_x_ti_60s": "large_trade_net_share_60s trade_imbalance_60s",
            "ofi_concord_wide_gate": "ofi_concord wide",
        },
    ),
    (
        "z60(x1) * sgn(x2)",
        {
            "cancel_x_ofi": "cancel_ratio_60s ofi_60s",
            "gap_x_direction": "trade_gap_ms trade_imbalance_60s",
            "ofi_x_premium_sign": "ofi_60s iopv_premium",
            "signed_arrival_z": "n_trades_60s trade_imbalance_60s",
            "size_x_direction": "avg_trade_size_60s trade_imbalance_60s",
        },
    ),
    (
        "delta10(x1)",
        {
            "iopv_premium_mom": "iopv_premium",
            "depth5_delta_30s": "imb5",
            "top_book_delta_30s": "imb1",
            "wdi_mom_30s": "wdi",
        },
    ),
    (
        "z100(x1) - z100(delta5(z100(x1)))",
        {
            "book_slope_zvel_div_15s": "book_slope",
            "fullbook_imb_zvel_div_15s": "imb_full",
            "oir_zvel_div_15s": "oir",
            "rv300_logzvel_div_15s": "logrv300",
        },
    ),
    (
        "delta5(delta5(delta5(z100(x1)))) * abs(z100(x1))",
        {
            "fullbook_imb_zjerk_extreme_15s": "imb_full",
            "lastgap_zjerk_extreme_15s": "lastgap",
            "oir_zjerk_extreme_15s": "oir",
            "wdi_zjerk_extreme_15s": "wdi",
        },
    ),
    (
        "z100(delta5(z100(x1))) * z100(delta5(delta5(z100(x1))))",
        {
            "fullbook_imb_zvel_x_zaccel_15s": "imb_full",
            "lastgap_zvel_x_zaccel_15s": "lastgap",
            "oir_zvel_x_zaccel_15s": "oir",
            "wdi_zvel_x_zaccel_15s": "wdi",
        },
    ),
    (
        "z100(delta5(z100(x1))) / (1 + abs(z100(delta5(delta5(z100(x1))))))",
        {
            "fullbook_imb_vel_accel_div_15s": "imb_full",
            "lastgap_vel_accel_div_15s": "lastgap",
            "oir_vel_accel_div_15s": "oir",
            "wdi_vel_accel_div_15s": "wdi",
        },
    ),
    (
        "if(isnull(z100(x1)) | isnull(delta5(delta5(z100(x1)))), null, if(abs(z100(x1)) > 2, delta5(delta5(z100(x1))) * abs(z100(x1)), 0))",
        {
            "depth5_imb_zaccel_2sig_extreme_15s": "imb5",
            "ltns_zaccel_2sig_extreme_15s": "large_trade_net_share_60s",
            "microprice_dev_zaccel_2sig_extreme_15s": "microprice_dev",
            "ti60_zaccel_2sig_extreme_15s": "trade_imbalance_60s",
        },
    ),
    (
        "mean100(x1)",
        {
            "iopv_vel_drift_300s": "iopv_velocity",
            "large_net_accum_300s": "large_trade_net_share_60s",
            "ti15_accum_300s": "trade_imbalance_15s",
        },
    ),
    (
        "x1 * z100(x2)",
        {
            "dev_open_x_ofi_z": "opendev ofi_60s",
            "dev_open_x_spread_z": "opendev quoted_spread_ticks",
            "ofi_concord_x_spread_z": "ofi_concord quoted_spread_ticks",
        },
    ),
    (
        "delta20(z100(x1))",
        {
            "hidden_ask_supply_z_vel_60s": "hidden_ask_share",
            "hidden_bid_support_z_vel_60s": "hidden_bid_share",
            "open_dev_z_accel": "opendev",
        },
    ),
    (
        "z100(x1) - z100(delta20(z100(x1)))",
        {
            "iopv_prem_zvel_div_60s": "iopv_premium",
            "ltns_zvel_div_60s": "large_trade_net_share_60s",
            "rv60_logzvel_div_60s": "logrv60",
        },
    ),
    (
        "delta5(z100(x1)) * wma20(abs(z100(x1)))",
        {
            "fullbook_imb_zvel_extreme_decay_15s": "imb_full",
            "oir_zvel_extreme_decay_15s": "oir",
            "wdi_zvel_extreme_decay_15s": "wdi",
        },
    ),
    (
        "delta5(z100(x1)) * sgn(delta20(z100(x1)))",
        {
            "fullbook_imb_vel15_x_vel60": "imb_full",
            "ti60_vel15_x_vel60": "trade_imbalance_60s",
            "wdi_vel15_x_vel60": "wdi",
        },
    ),
    (
        "mean100(if(isnull(x1), null, if(x1 > 0, 1, 0)))",
        {
            "div_pos_frac_300s": "imb_gap",
            "ofi_pos_frac_300s": "ofi_60s",
            "ti_pos_frac_300s": "trade_imbalance_60s",
        },
    ),
    (
        "(delta5(delta5(z100(x1))) * sgn(delta20(delta20(z100(x1))))) * abs(z100(x1))",
        {
            "fullbook_imb_zaccel_15s_x_60s": "imb_full",
            "oir_zaccel_15s_x_60s": "oir",
            "wdi_zaccel_15s_x_60s": "wdi",
        },
    ),
    (
        "((delta5(delta5(z100(x1))) * abs(delta20(delta20(z100(x1))))) * abs(z100(x1))) * (sgn(delta5(delta5(z100(x1)))) = sgn(delta20(delta20(z100(x1)))))",
        {
            "fullbook_imb_zaccel_ts_agree": "imb_full",
            "oir_zaccel_ts_agree": "oir",
            "wdi_zaccel_ts_agree": "wdi",
        },
    ),
    (
        "(if(isnull(z100(x1)) | isnull(lag5(z100(x1))), null, if(((sgn(z100(x1)) != sgn(lag5(z100(x1)))) & (z100(x1) != 0)) & (lag5(z100(x1)) != 0), 1, 0)) * delta5(z100(x1))) * z100(x2)",
        {
            "fullbook_imb_zcross_x_spread_z": "imb_full quoted_spread_ticks",
            "oir_zcross_x_spread_z": "oir quoted_spread_ticks",
            "wdi_zcross_x_spread_z": "wdi quoted_spread_ticks",
        },
    ),
    (
        "z60(x1)",
        {
            "intensity_z_180s": "book_event_intensity_60s",
            "ltns_z_180s": "large_trade_net_share_60s",
        },
    ),
    (
        "x1 - x2",
        {
            "ofi_accel_15_60": "ofi_15s ofi_60s",
            "ti_accel_15_60": "trade_imbalance_15s trade_imbalance_60s",
        },
    ),
    (
        "delta40(x1)",
        {
            "depth5_delta_120s": "imb5",
            "top_book_delta_120s": "imb1",
        },
    ),
    (
        "delta100(x1)",
        {
            "large_share_mom_300s": "large_trade_share_60s",
            "range_pos_delta_300s": "range_pos",
        },
    ),
    (
        "delta20(x1) * x2",
        {
            "fbi_mom_wide_gate": "imb_full wide",
            "oir_mom_spread_wide_gate": "oir quoted_spread_ticks",
        },
    ),
    (
        "mean100(sgn(x1))",
        {
            "gap_pin_persist_300s": "lastgap",
            "ofi_sign_run_300s": "ofi_15s",
        },
    ),
    (
        "delta5(z100(x1))",
        {
            "hidden_ask_supply_z_vel_15s": "hidden_ask_share",
            "hidden_bid_support_z_vel_15s": "hidden_bid_share",
        },
    ),
    (
        "z100(mean100(x1))",
        {
            "ntrades_pace_z_300s": "n_trades_60s",
            "size_regime_z_300s": "avg_trade_size_60s",
        },
    ),
    (
        "z40(x1) * z60(x2)",
        {
            "ofi_z_x_intensity_z": "ofi_60s book_event_intensity_60s",
            "ti_z_x_intensity_z": "trade_imbalance_60s book_event_intensity_60s",
        },
    ),
    (
        "z60(x1) * z100(x2)",
        {
            "ofi_z_x_spread_z": "ofi_60s quoted_spread_ticks",
            "ti_z_x_spread_z": "trade_imbalance_60s quoted_spread_ticks",
        },
    ),
    (
        "z100(x1) - z100(x2)",
        {
            "flow_divergence_300s": "ofi_60s trade_imbalance_60s",
            "buysell_regime_gap_300s": "buy_vol_60s sell_vol_60s",
        },
    ),
    (
        "z100(x1) * -z100(x2)",
        {
            "gap_slope_thinwalk_300s": "lastgap book_slope",
            "micro_slope_unsupported_300s": "microprice_dev book_slope",
        },
    ),
    (
        "mean100(x1) * z100(x2)",
        {
            "iopv_drift_x_fbi": "iopv_velocity imb_full",
            "iopv_drift_x_spread_z": "iopv_velocity quoted_spread_ticks",
        },
    ),
    (
        "z100(x1 - x2) * z100(x3)",
        {
            "conc_imb_x_rv_z": "conc_bid conc_ask rv_60s",
            "conc_imb_x_spread_z": "conc_bid conc_ask quoted_spread_ticks",
        },
    ),
    (
        "z100(x1) * -sgn(z100(x2))",
        {
            "gap_ofi_conflict_60s": "lastgap ofi_60s",
            "micro_ofi_absorb_60s": "microprice_dev ofi_60s",
        },
    ),
    (
        "z100(x1) * delta5(z100(x1))",
        {
            "fullbook_imb_z_x_vel_15s": "imb_full",
            "ofi_z_x_vel_15s": "ofi_60s",
        },
    ),
    (
        "z100(x1) * delta5(z100(x2))",
        {
            "hidden_ask_x_sellvel_15s": "hidden_ask_share sell_vol_60s",
            "hidden_bid_x_buyvel_15s": "hidden_bid_share buy_vol_60s",
        },
    ),
    (
        "delta20(z100(x1)) * abs(z100(x1))",
        {
            "event_int_zvel_extreme_60s": "book_event_intensity_60s",
            "iopv_prem_zvel_extreme_60s": "iopv_premium",
        },
    ),
    (
        "if(notnull(z100(x1)) & notnull(z100(x2)), z100(x1) * z100(x2), null)",
        {
            "prem_x_cancel": "iopv_premium cancel_ratio_60s",
            "regime_vol_x_flow": "rv_300s trade_imbalance_60s",
        },
    ),
    (
        "if(notnull(zN100(x1)) & notnull(zN100(x2)), zN100(x1) * zN100(x2), null)",
        {
            "prem_x_ofi": "iopv_premium ofi_60s",
            "prem_x_wdi": "iopv_premium wdi",
        },
    ),
    (
        "if(isnull(z100(x1)) | isnull(delta5(z100(x1))), null, if(z100(x1) > 2, delta5(z100(x1)) * z100(x1), 0))",
        {
            "oir_zvel_pos_extreme_15s": "oir",
            "wdi_zvel_pos_extreme_15s": "wdi",
        },
    ),
    (
        "if(isnull(z100(x1)) | isnull(delta5(z100(x1))), null, if(z100(x1) < -2, delta5(z100(x1)) * z100(x1), 0))",
        {
            "fullbook_imb_zvel_neg_extreme_15s": "imb_full",
            "wdi_zvel_neg_extreme_15s": "wdi",
        },
    ),
    (
        "if(isnull(z100(x1)) | isnull(delta5(z100(x1))), null, if(abs(z100(x1)) > 2, delta5(z100(x1)) * abs(z100(x1)), 0))",
        {
            "microprice_dev_zvel_2sig_extreme_15s": "microprice_dev",
            "wdi_zvel_2sig_extreme_15s": "wdi",
        },
    ),
    (
        "if(isnull(z100(x1)) | isnull(delta5(z100(x1))), null, if(abs(z100(x1)) > 1.5, delta5(z100(x1)) * abs(z100(x1)), 0))",
        {
            "oir_zvel_1p5sig_extreme_15s": "oir",
            "wdi_zvel_1p5sig_extreme_15s": "wdi",
        },
    ),
    (
        "if(isnull(z100(x1)) | isnull(delta5(delta5(z100(x1)))), null, if(abs(z100(x1)) > 2.5, delta5(delta5(z100(x1))) * abs(z100(x1)), 0))",
        {
            "fullbook_imb_zaccel_2p5sig_extreme_15s": "imb_full",
            "oir_zaccel_2p5sig_extreme_15s": "oir",
        },
    ),
    (
        "(if(isnull(z100(x1)) | isnull(lag5(z100(x1))), null, if(((sgn(z100(x1)) != sgn(lag5(z100(x1)))) & (z100(x1) != 0)) & (lag5(z100(x1)) != 0), 1, 0)) * delta5(z100(x1))) * (delta5(z100(x2)) * abs(z100(x2)))",
        {
            "fullbook_imb_zcross_x_wdi_zvel": "imb_full wdi",
            "oir_zcross_x_fullbook_imb_zvel": "oir imb_full",
        },
    ),
    (
        "if(isnull(z100(delta5(z100(x1)))) | isnull(z100(delta5(delta5(z100(x1))))), null, if((z100(delta5(z100(x1))) * z100(delta5(delta5(z100(x1))))) < 0, z100(delta5(z100(x1))) * z100(delta5(delta5(z100(x1)))), 0))",
        {
            "oir_zvel_zaccel_disagree_extreme_15s": "oir",
            "wdi_zvel_zaccel_disagree_extreme_15s": "wdi",
        },
    ),
    (
        "z20(quoted_spread_ticks)",
        {"spread_z_60s": ""},
    ),
    (
        "z200(iopv_premium)",
        {"iopv_premium_z_600s": ""},
    ),
    (
        "mean10(lastgap)",
        {"last_mid_gap_ma_30s": ""},
    ),
    (
        "mean40(trade_imbalance_60s)",
        {"ti_accum_120s": ""},
    ),
    (
        "delta5(visible_share)",
        {"vis_share_vel_15s": ""},
    ),
    (
        "delta60(wdi)",
        {"wdi_mom_180s": ""},
    ),
    (
        "z40(ofi_15s) * quoted_spread_ticks",
        {"ofi_15sz_spread_wide_gate": ""},
    ),
    (
        "z60(ofi_30s - ofi_60s)",
        {"ofi_accel_z_180s": ""},
    ),
    (
        "z60(trade_imbalance_60s) * large_trade_share_60s",
        {"ti_z_x_large_share": ""},
    ),
    (
        "z100(conc_bid - conc_ask)",
        {"conc_imb_z_300s": ""},
    ),
    (
        "z100(iopv_velocity * ofi_60s)",
        {"iopv_vel_x_ofi_z": ""},
    ),
    (
        "z100(hidden_bid_share) * -trade_imbalance_60s",
        {"bid_absorb_x_sell": ""},
    ),
    (
        "(trade_imbalance_15s - trade_imbalance_60s) * wide",
        {"ti_accel_wide_gate": ""},
    ),
    (
        "delta5(log(mid_px))",
        {"log_mid_ret_15s": ""},
    ),
    (
        "(range_pos - 0.5) * wdi",
        {"range_pos_x_wdi": ""},
    ),
    (
        "delta20(conc_bid - conc_ask)",
        {"conc_imb_mom_60s": ""},
    ),
    (
        "mean100(iopv_velocity) * wide",
        {"iopv_drift_wide_gate": ""},
    ),
    (
        "delta40(log(mid_px))",
        {"log_mid_ret_120s": ""},
    ),
    (
        "delta10(log(mid_px))",
        {"log_mid_ret_30s": ""},
    ),
    (
        "mean100(buy_vol_60s - sell_vol_60s)",
        {"netvol_accum_300s": ""},
    ),
    (
        "delta20(z60(ofi_60s))",
        {"ofi_mom_60s": ""},
    ),
    (
        "z40(delta20(book_slope))",
        {"slope_vel_z_120s": ""},
    ),
    (
        "z600(mean100(n_trades_60s))",
        {"trade_arrival_burst": ""},
    ),
    (
        "delta100(abs(opendev))",
        {"abs_open_dev_delta_300s": ""},
    ),
    (
        "z40(ofi_60s) - z40(trade_imbalance_60s)",
        {"flow_divergence_120s": ""},
    ),
    (
        "z20(ofi_60s) - z20(trade_imbalance_60s)",
        {"flow_divergence_60s": ""},
    ),
    (
        "sgn(mid_px - open_px) * wdi",
        {"open_dev_sign_x_wdi": ""},
    ),
    (
        "opendev * sgn(open_px - pre_close_px)",
        {"open_dev_x_gapdir": ""},
    ),
    (
        "delta100(range_pos) * trade_imbalance_60s",
        {"range_pos_delta_x_ti": ""},
    ),
    (
        "ofi_concord * sgn(z100(quoted_spread_ticks))",
        {"ofi_concord_flip_gate": ""},
    ),
    (
        "sgn(trade_imbalance_15s) * z100(ofi_60s)",
        {"ti15_sign_x_ofi_z": ""},
    ),
    (
        "mean20(sgn(last_px - mid_px))",
        {"aggressor_share_60s": ""},
    ),
    (
        "(range_pos - 0.5) * z60(ofi_60s)",
        {"range_pos_x_ofi_z": ""},
    ),
    (
        "z100((high_px - low_px) / mid_px)",
        {"range_width_z_300s": ""},
    ),
    (
        "(trade_imbalance_15s - trade_imbalance_60s) * z100(quoted_spread_ticks)",
        {"ti_accel_x_spread_z": ""},
    ),
    (
        "delta30(delta30(wdi))",
        {"wdi_accel_90s": ""},
    ),
    (
        "ewm(0.01376, 100, trade_imbalance_60s)",
        {"ti_ewm_state_300s": ""},
    ),
    (
        "(range_pos - 0.5) * z100(quoted_spread_ticks)",
        {"range_pos_x_spread_z": ""},
    ),
    (
        "trade_imbalance_15s / clip(rv60_regime, 0.5, 2)",
        {"ti15_per_vol_regime": ""},
    ),
    (
        "delta20(imb_full) * z100(quoted_spread_ticks)",
        {"fbi_mom_x_spread_z": ""},
    ),
    (
        "mean10(ofi_60s) - mean60(ofi_60s)",
        {"ofi_fast_slow": ""},
    ),
    (
        "z100(ofi_60s) * sgn(pre_close_px - mid_px)",
        {"ofi_z_x_gap_fill_dir": ""},
    ),
    (
        "delta40((high_px - low_px) / mid_px)",
        {"range_width_delta_120s": ""},
    ),
    (
        "(abs(range_pos - 0.5) * 2) * trade_imbalance_60s",
        {"dayedge_x_ti60": ""},
    ),
    (
        "delta20(lastgap) - delta60(lastgap)",
        {"gap_accel_60_180": ""},
    ),
    (
        "z100(ofi_60s) / clip(rv60_regime, 0.5, 2)",
        {"ofi_per_vol_z_300s": ""},
    ),
    (
        "z100(ofi_60s) * z100(mean20(book_event_intensity_60s))",
        {"ofi_z_x_intens_regime": ""},
    ),
    (
        "delta20(z100(hidden_bid_share)) * z100(buy_vol_60s)",
        {"hidden_bid_arrival_x_buyvol": ""},
    ),
    (
        "delta20(z100(hidden_bid_share) - z100(hidden_ask_share))",
        {"hidden_side_gap_vel_60s": ""},
    ),
    (
        "z100(delta20(imb1)) * z100(book_slope)",
        {"queue_pressure_x_slope": ""},
    ),
    (
        "((open_px - pre_close_px) / pre_close_px) * (range_pos - 0.5)",
        {"overnight_gap_x_range_pos": ""},
    ),
    (
        "z60(abs(delta1(trade_imbalance_60s))) * sgn(trade_imbalance_60s)",
        {"flow_accel_signed": ""},
    ),
    (
        "(z40(ofi_60s) - z40(trade_imbalance_60s)) * z100(quoted_spread_ticks)",
        {"flow_divergence_x_spread_z": ""},
    ),
    (
        "z100(imb_gap) * (abs(range_pos - 0.5) * 2)",
        {"top5div_x_extremes": ""},
    ),
    (
        "z100(if(avg_trade_size_60s > 0, log(avg_trade_size_60s), null))",
        {"trade_size_z_300s": ""},
    ),
    (
        "delta20(if(avg_trade_size_60s > 0, log(avg_trade_size_60s), null))",
        {"trade_size_mom_60s": ""},
    ),
    (
        "delta20(log(mid_px)) - delta60(log(mid_px))",
        {"price_accel_60_180": ""},
    ),
    (
        "z100((max100(mid_px) - min100(mid_px)) / mid_px)",
        {"roll_range_width_z_300s": ""},
    ),
    (
        "z100(delta10(if(cum_trade_vol > 0, log(cum_trade_vol), null)))",
        {"vol_tempo_z_300s": ""},
    ),
    (
        "z100(if(avg_trade_size_60s > 0, log(avg_trade_size_60s), null)) * z100(ofi_60s)",
        {"size_z_x_ofi_z": ""},
    ),
    (
        "ewm(0.12944, 20, trade_imbalance_60s) - ewm(0.03406, 60, trade_imbalance_60s)",
        {"ti_ewm_accel_120s": ""},
    ),
    (
        "z100(if((depth_bid5 + depth_ask5) > 0, log(depth_bid5 + depth_ask5), null))",
        {"depth_thickness_z_300s": ""},
    ),
    (
        "mean100(iopv_velocity) * (wide + (0.5 * (wide - z100(quoted_spread_ticks))))",
        {"iopv_drift_asym_gate": ""},
    ),
    (
        "((delta200(high_px) + delta200(low_px)) / mid_px) * 10000",
        {"net_extreme_drift_600s": ""},
    ),
    (
        "(delta5(z100(wdi)) * abs(z100(wdi))) * sgn(ofi_60s)",
        {"wdi_zvel_x_ofi_sign": ""},
    ),
    (
        "(z100(hidden_bid_share) * z100(buy_vol_60s)) - (z100(hidden_ask_share) * z100(sell_vol_60s))",
        {"hidden_flow_align_net": ""},
    ),
    (
        "if(notnull(rv_300s) & (rv_300s > 1e-14), rv_60s / rv_300s, null)",
        {"rv_ratio_60_300": ""},
    ),
    (
        "(delta5(z100(wdi)) * abs(z100(wdi))) * z100(quoted_spread_ticks)",
        {"wdi_zvel_x_spread_z": ""},
    ),
    (
        "z100(if((hidden_bid + hidden_ask) > 0, (hidden_bid - hidden_ask) / (hidden_bid + hidden_ask), 0))",
        {"hidden_imb_z_300s": ""},
    ),
    (
        "delta20((high_px - low_px) / mid_px) - delta100((high_px - low_px) / mid_px)",
        {"range_accel_60_300": ""},
    ),
    (
        "z100(if(notnull(rv_300s) & (rv_300s > 1e-14), rv_60s / rv_300s, null))",
        {"rv_ratio_z_300s": ""},
    ),
    (
        "z100(if((bid1_qty + ask1_qty) > 0, (depth_bid5 + depth_ask5) / (bid1_qty + ask1_qty), null))",
        {"depth_ratio_5to1_z": ""},
    ),
    (
        "if(notnull(day_range) & (day_range > 1e-12), (mid_px - open_px) / day_range, null)",
        {"stretch_per_day_range": ""},
    ),
    (
        "sgn(trade_imbalance_15s) * (((abs(trade_imbalance_15s) + abs(trade_imbalance_60s)) - abs(trade_imbalance_15s - trade_imbalance_60s)) / 2)",
        {"ti_concord_15_60": ""},
    ),
    (
        "sum20(sgn(delta1(log(mid_px))) * pow(delta1(log(mid_px)), 2))",
        {"signed_rv_60s": ""},
    ),
    (
        "if(notnull(z40(iopv_premium)) & notnull(wdi), z40(iopv_premium) * wdi, null)",
        {"prem_x_depth_imb": ""},
    ),
    (
        "delta20(mean100(if(isnull(imb_gap), null, if(imb_gap > 0, 1, 0))))",
        {"div_pos_frac_vel_60s": ""},
    ),
    (
        "if(isnull(hidden_imb * trade_imbalance_60s), null, if((hidden_imb * trade_imbalance_60s) > 0, hidden_imb * trade_imbalance_60s, 0))",
        {"hidden_imb_x_ti_agree_60s": ""},
    ),
    (
        "if(isnull(hidden_imb * trade_imbalance_60s), null, if((hidden_imb * trade_imbalance_60s) < 0, hidden_imb * trade_imbalance_60s, 0))",
        {"hidden_imb_x_ti_disagree_60s": ""},
    ),
    (
        "if(notnull(z100(large_trade_share_60s)) & notnull(trade_imbalance_60s), z100(large_trade_share_60s) * sgn(trade_imbalance_60s), null)",
        {"large_share_z_x_ti": ""},
    ),
    (
        "if(notnull(rv_60s) & (rv_60s > 1e-14), delta20(log(mid_px)) / sqrt(rv_60s), null)",
        {"vol_adj_mom_60s": ""},
    ),
    (
        "z100(if(notnull(depth_bid5 + depth_ask5) & ((depth_bid5 + depth_ask5) > 0), ofi_60s / (depth_bid5 + depth_ask5), null))",
        {"ofi_per_depth_z_300s": ""},
    ),
    (
        "if(notnull(z100(iopv_premium)) & notnull(z100(rv_300s)), -z100(iopv_premium) * z100(rv_300s), null)",
        {"prem_reversion_x_rv": ""},
    ),
    (
        "if(notnull(std100(ofi_15s)) & (std100(ofi_15s) = 0), 0, mean100(ofi_15s) / std100(ofi_15s))",
        {"ofi_flow_tstat_300s": ""},
    ),
    (
        "(delta5(z100(wdi)) * abs(z100(wdi))) * (delta5(z100(oir)) * abs(z100(oir)))",
        {"wdi_zvel_x_oir_zvel": ""},
    ),
    (
        "z40(if(notnull(buy_vol_60s + sell_vol_60s) & ((buy_vol_60s + sell_vol_60s) > 0), (buy_vol_60s - sell_vol_60s) / (buy_vol_60s + sell_vol_60s), null))",
        {"netbuy_pressure_z_120s": ""},
    ),
    (
        "delta20(if(notnull(buy_vol_60s + sell_vol_60s) & ((buy_vol_60s + sell_vol_60s) > 0), (buy_vol_60s - sell_vol_60s) / (buy_vol_60s + sell_vol_60s), null))",
        {"netbuy_pressure_delta_60s": ""},
    ),
    (
        "if(isnull(z100(book_slope)) | isnull(z100(ofi_60s)), null, if(z100(book_slope) < 0, z100(ofi_60s), 0))",
        {"slope_gated_ofi_300s": ""},
    ),
    (
        "if(notnull(z100(delta1(cum_trade_vol))) & notnull(trade_imbalance_60s), z100(delta1(cum_trade_vol)) * sgn(trade_imbalance_60s), null)",
        {"vol_rate_x_ti": ""},
    ),
    (
        "if(ts_ms <= 41400000.0, ts_ms - 34200000.0, 7200000 + (ts_ms - 46800000.0)) / 14400000.0",
        {"session_clock": ""},
    ),
    (
        "if(notnull(delta10(z100(n_trades_60s))) & notnull(trade_imbalance_60s), delta10(z100(n_trades_60s)) * sgn(trade_imbalance_60s), null)",
        {"arrival_accel_x_ti": ""},
    ),
    (
        "(z100(imb_gap) * z100(visible_share)) * if(isnull(mean100(quoted_spread_ticks)), null, if(quoted_spread_ticks > mean100(quoted_spread_ticks), 1, 0))",
        {"div_vis_wide_walk": ""},
    ),
    (
        "if(notnull(max100(mid_px) - min100(mid_px)) & (day_range > 1e-12), (max100(mid_px) - min100(mid_px)) / day_range, null)",
        {"recent_range_share_300s": ""},
    ),
    (
        "if(isnull(z100(imb5)) | isnull(delta5(z100(imb5))), null, if(delta5(z100(imb5)) < 0, z100(imb5), 0))",
        {"depth5_imb_z_velneg_gate_15s": ""},
    ),
    (
        "if(isnull(z100(oir)) | isnull(delta5(z100(oir))), null, if(delta5(z100(oir)) > 0, z100(oir), 0))",
        {"oir_z_velpos_gate_15s": ""},
    ),
    (
        "if(notnull(cum_max(abs(opendev))) & (cum_max(abs(opendev)) > 1e-12), abs(opendev) / cum_max(abs(opendev)), null)",
        {"open_dev_extremeness": ""},
    ),
    (
        "(delta5(z100(wdi)) * abs(z100(wdi))) * if(isnull(mean100(rv_60s)), null, if(rv_60s > mean100(rv_60s), 1, -1))",
        {"wdi_zvel_x_rv_regime": ""},
    ),
    (
        "if(isnull(large_trade_net_share_60s) | isnull(z40(trade_imbalance_15s)), null, if((sgn(large_trade_net_share_60s) = sgn(z40(trade_imbalance_15s))) & (large_trade_net_share_60s != 0), 1, 0)) * z40(trade_imbalance_15s)",
        {"ltns_confirms_ti15_z": ""},
    ),
    (
        "if(abs(open_px - pre_close_px) >= 0.001, sgn((mid_px - pre_close_px) / (open_px - pre_close_px)) * log(abs((mid_px - pre_close_px) / (open_px - pre_close_px)) + 1), null)",
        {"gap_fill_ratio": ""},
    ),
    (
        "mean100(if(isnull(delta20(z100(hidden_bid_share) - z100(hidden_ask_share))), null, if(delta20(z100(hidden_bid_share) - z100(hidden_ask_share)) > 0, 1, 0)))",
        {"hidden_rot_pos_frac_300s": ""},
    ),
    (
        "if(isnull(large_trade_net_share_60s) | isnull(z100(ofi_60s)), null, if((sgn(large_trade_net_share_60s) = sgn(z100(ofi_60s))) & (large_trade_net_share_60s != 0), 1, 0)) * z100(ofi_60s)",
        {"ltns_confirms_ofi_z": ""},
    ),
    (
        "if(notnull(z100(if(avg_trade_size_60s > 0, log(avg_trade_size_60s), null))) & notnull(trade_imbalance_30s), z100(if(avg_trade_size_60s > 0, log(avg_trade_size_60s), null)) * trade_imbalance_30s, null)",
        {"size_z_x_ti_30s": ""},
    ),
    (
        "mean20(if(isnull(sgn(ofi_60s)) | isnull(sgn(trade_imbalance_60s)), null, if((sgn(ofi_60s) = sgn(trade_imbalance_60s)) & (sgn(ofi_60s) != 0), 1, 0))) - 0.5",
        {"ofi_ti_agree_60s": ""},
    ),
    (
        "if(notnull(z100(delta1(cum_trade_vol))) & notnull(delta20(log(mid_px))), z100(delta1(cum_trade_vol)) * sgn(delta20(log(mid_px))), null)",
        {"vol_confirmed_mom": ""},
    ),
    (
        "(ts_ms - cum_max(if(if(if(mid_px > open_px, 1, -1) != lag1(if(mid_px > open_px, 1, -1)), 1, 0) > 0.5, ts_ms, cum_min(ts_ms)))) / 3000",
        {"bars_since_open_cross": ""},
    ),
    (
        "if(((ts_ms >= 34200000.0) & (ts_ms < 36000000.0)) | ((ts_ms >= 52200000.0) & (ts_ms < 54000000.0)), 1, -1) * delta20(log(mid_px))",
        {"session_u_x_mom": ""},
    ),
    (
        "if(isnull(z100(wdi)) | isnull(delta5(z100(wdi))), null, if(abs(z100(wdi)) > 3, delta5(z100(wdi)) * abs(z100(wdi)), 0))",
        {"wdi_zvel_3sig_extreme_15s": ""},
    ),
    (
        "if(isnull(z100(imb_full)) | isnull(delta5(z100(imb_full))), null, if(abs(z100(imb_full)) > 2.5, delta5(z100(imb_full)) * abs(z100(imb_full)), 0))",
        {"fullbook_imb_zvel_2p5sig_extreme_15s": ""},
    ),
    (
        "if(isnull(z100(microprice_dev)) | isnull(delta5(z100(microprice_dev))), null, if((z100(microprice_dev) > 0) & (delta5(z100(microprice_dev)) < 0), 1, 0)) * z100(microprice_dev)",
        {"microprice_dev_z_fade_pos_15s": ""},
    ),
    (
        "if(isnull(z100(trade_imbalance_60s)) | isnull(delta5(z100(trade_imbalance_60s))), null, if((z100(trade_imbalance_60s) < 0) & (delta5(z100(trade_imbalance_60s)) > 0), 1, 0)) * z100(trade_imbalance_60s)",
        {"ti60_z_fade_neg_15s": ""},
    ),
    (
        "min10(if(isnull(sgn(trade_imbalance_15s)) | isnull(lag1(sgn(trade_imbalance_15s))), null, if((sgn(trade_imbalance_15s) = lag1(sgn(trade_imbalance_15s))) & (sgn(trade_imbalance_15s) != 0), 1, 0))) * trade_imbalance_15s",
        {"ti_sign_streak_30s": ""},
    ),
    (
        "z100(oir) * ((mean100(if(isnull(z100(oir)) | isnull(delta5(z100(oir))), null, if(delta5(z100(oir)) > 0, 1, 0))) - 0.5) * 2)",
        {"oir_z_x_velfrac_15s": ""},
    ),
    (
        "mean20(if(isnull(sgn(trade_imbalance_15s)) | isnull(sgn(ofi_60s)), null, if(((sgn(trade_imbalance_15s) != sgn(ofi_60s)) & (sgn(trade_imbalance_15s) != 0)) & (sgn(ofi_60s) != 0), 1, 0))) * -trade_imbalance_15s",
        {"trade_book_conflict_60s": ""},
    ),
    (
        "z100(if(notnull(depth_bid5 + depth_ask5) & ((depth_bid5 + depth_ask5) > 0), ofi_60s / (depth_bid5 + depth_ask5), null)) * if(isnull(mean100(quoted_spread_ticks)), null, if(quoted_spread_ticks > mean100(quoted_spread_ticks), 1, 0))",
        {"ofi_pdepth_wide_walk": ""},
    ),
    (
        "if(notnull(max100(mid_px) - min100(mid_px)) & ((max100(mid_px) - min100(mid_px)) > 1e-12), (mid_px - min100(mid_px)) / (max100(mid_px) - min100(mid_px)), null)",
        {"mid_roll_range_pos_300s": ""},
    ),
    (
        "if(notnull(max100(mid_px) - min100(mid_px)) & ((max100(mid_px) - min100(mid_px)) > 1e-12), (open_px - min100(mid_px)) / (max100(mid_px) - min100(mid_px)), null)",
        {"open_pos_roll_range_300s": ""},
    ),
    (
        "mean100(if(isnull(if((hidden_bid + hidden_ask) > 0, (hidden_bid - hidden_ask) / (hidden_bid + hidden_ask), 0)), null, if(if((hidden_bid + hidden_ask) > 0, (hidden_bid - hidden_ask) / (hidden_bid + hidden_ask), 0) > 0, 1, 0)))",
        {"hidden_imb_pos_frac_300s": ""},
    ),
    (
        "((ts_ms - cum_max(if(if(if(mid_px > open_px, 1, -1) != lag1(if(mid_px > open_px, 1, -1)), 1, 0) > 0.5, ts_ms, cum_min(ts_ms)))) / 3000) * if(mid_px > open_px, 1, -1)",
        {"open_side_hold_bars": ""},
    ),
    (
        "if(isnull(z100(wdi)) | isnull(delta5(delta5(z100(wdi)))), null, if(abs(z100(wdi)) > 3, delta5(delta5(z100(wdi))) * abs(z100(wdi)), 0))",
        {"wdi_zaccel_3sig_extreme_15s": ""},
    ),
    (
        "mean100(if(isnull(sgn(microprice_dev)) | isnull(sgn(trade_imbalance_60s)), null, if(((sgn(microprice_dev) != sgn(trade_imbalance_60s)) & (sgn(microprice_dev) != 0)) & (sgn(trade_imbalance_60s) != 0), 1, 0))) * z100(microprice_dev)",
        {"micro_ti_absorb_300s": ""},
    ),
    (
        "((mean20(if(isnull(sgn(ofi_15s)) | isnull(lag1(sgn(ofi_15s))), null, if((sgn(ofi_15s) = lag1(sgn(ofi_15s))) & (sgn(ofi_15s) != 0), 1, 0))) - 0.5) * 2) * sgn(ofi_15s)",
        {"ofi_sign_persist_60s": ""},
    ),
    (
        "delta20(mean100(if(isnull(if((hidden_bid + hidden_ask) > 0, (hidden_bid - hidden_ask) / (hidden_bid + hidden_ask), 0)), null, if(if((hidden_bid + hidden_ask) > 0, (hidden_bid - hidden_ask) / (hidden_bid + hidden_ask), 0) > 0, 1, 0))))",
        {"hidden_imb_pos_frac_vel_60s": ""},
    ),
    (
        "(((mean20(if(isnull(sgn(ofi_15s)) | isnull(lag1(sgn(ofi_15s))), null, if((sgn(ofi_15s) = lag1(sgn(ofi_15s))) & (sgn(ofi_15s) != 0), 1, 0))) - 0.5) * 2) * sgn(ofi_15s)) * wide",
        {"ofi_persist_wide_gate": ""},
    ),
    (
        "if((notnull(mean100(depth_bid5 + depth_ask5)) & (mean100(depth_bid5 + depth_ask5) > 0)) & notnull(delta20(depth_bid5 + depth_ask5) / mean100(depth_bid5 + depth_ask5)), delta20(depth_bid5 + depth_ask5) / mean100(depth_bid5 + depth_ask5), null)",
        {"depth_resiliency": ""},
    ),
    (
        "(if(notnull(max100(mid_px) - min100(mid_px)) & ((max100(mid_px) - min100(mid_px)) > 1e-12), (mid_px - min100(mid_px)) / (max100(mid_px) - min100(mid_px)), null) - 0.5) * z100(quoted_spread_ticks)",
        {"rollrpos_x_spread_z": ""},
    ),
    (
        "(mean40(if(isnull(sgn(trade_imbalance_15s)) | isnull(sgn(lag2(z100(ofi_60s)))), null, if((sgn(trade_imbalance_15s) = sgn(lag2(z100(ofi_60s)))) & (sgn(trade_imbalance_15s) != 0), 1, 0))) - 0.5) * sgn(z100(ofi_60s))",
        {"book_leads_trade_120s": ""},
    ),
    (
        "(((mean20(if(isnull(sgn(ofi_15s)) | isnull(lag1(sgn(ofi_15s))), null, if((sgn(ofi_15s) = lag1(sgn(ofi_15s))) & (sgn(ofi_15s) != 0), 1, 0))) - 0.5) * 2) * sgn(ofi_15s)) * z100(quoted_spread_ticks)",
        {"ofi_persist_x_spread_z": ""},
    ),
    (
        "(abs(if(notnull(max100(mid_px) - min100(mid_px)) & ((max100(mid_px) - min100(mid_px)) > 1e-12), (mid_px - min100(mid_px)) / (max100(mid_px) - min100(mid_px)), null) - 0.5) * 2) * trade_imbalance_15s",
        {"rollrpos_x_ti15": ""},
    ),
    (
        "min20(if(isnull(sgn(z100(ofi_60s))) | isnull(lag1(sgn(z100(ofi_60s)))), null, if((sgn(z100(ofi_60s)) = lag1(sgn(z100(ofi_60s)))) & (sgn(z100(ofi_60s)) != 0), 1, 0))) * z100(ofi_60s)",
        {"ofi_regime_mature_60s": ""},
    ),
    (
        "if(cum_sum(if((delta1(high_px) > 0) | (delta1(low_px) < 0), 1, 0)) >= 1, (ts_ms - cum_max(if(if((delta1(high_px) > 0) | (delta1(low_px) < 0), 1, 0) > 0.5, ts_ms, 0))) / 3000, null)",
        {"bars_since_extreme": ""},
    ),
    (
        "if(isnull(z100(logrv300)) | isnull(lag20(z100(logrv300))), null, if(((sgn(z100(logrv300)) != sgn(lag20(z100(logrv300)))) & (z100(logrv300) != 0)) & (lag20(z100(logrv300)) != 0), 1, 0)) * delta20(z100(logrv300))",
        {"rv300_logz_cross_vel_60s": ""},
    ),
    (
        "if((cum_sum(notnull(iopv_premium)) - notnull(iopv_premium)) >= 100, iopv_premium - ((cum_sum(iopv_premium) - iopv_premium) / if((cum_sum(notnull(iopv_premium)) - notnull(iopv_premium)) >= 100, cum_sum(notnull(iopv_premium)) - notnull(iopv_premium), 1)), null)",
        {"premium_dev_day": ""},
    ),
    (
        "(if(isnull(z100(imb_full)) | isnull(lag5(z100(imb_full))), null, if(((sgn(z100(imb_full)) != sgn(lag5(z100(imb_full)))) & (z100(imb_full) != 0)) & (lag5(z100(imb_full)) != 0), 1, 0)) * delta5(z100(imb_full))) * sgn(trade_imbalance_60s)",
        {"fullbook_imb_zcross_x_ti_sign": ""},
    ),
    (
        "-mean100(if(isnull(sgn(z100(ofi_60s))) | isnull(lag1(sgn(z100(ofi_60s)))), null, if(((sgn(z100(ofi_60s)) != lag1(sgn(z100(ofi_60s)))) & (sgn(z100(ofi_60s)) != 0)) & (lag1(sgn(z100(ofi_60s))) != 0), 1, 0))) * z100(ofi_60s)",
        {"ofi_flip_fade_300s": ""},
    ),
    (
        "delta20(if((if((total_bid_vol - depth_bid5) > 0, total_bid_vol - depth_bid5, 0) + if((total_ask_vol - depth_ask5) > 0, total_ask_vol - depth_ask5, 0)) > 0, (if((total_bid_vol - depth_bid5) > 0, total_bid_vol - depth_bid5, 0) - if((total_ask_vol - depth_ask5) > 0, total_ask_vol - depth_ask5, 0)) / (if((total_bid_vol - depth_bid5) > 0, total_bid_vol - depth_bid5, 0) + if((total_ask_vol - depth_ask5) > 0, total_ask_vol - depth_ask5, 0)), null))",
        {"hidden_imb_mom_60s": ""},
    ),
    (
        "delta100(if((if((total_bid_vol - depth_bid5) > 0, total_bid_vol - depth_bid5, 0) + if((total_ask_vol - depth_ask5) > 0, total_ask_vol - depth_ask5, 0)) > 0, (if((total_bid_vol - depth_bid5) > 0, total_bid_vol - depth_bid5, 0) - if((total_ask_vol - depth_ask5) > 0, total_ask_vol - depth_ask5, 0)) / (if((total_bid_vol - depth_bid5) > 0, total_bid_vol - depth_bid5, 0) + if((total_ask_vol - depth_ask5) > 0, total_ask_vol - depth_ask5, 0)), null))",
        {"hidden_imb_mom_300s": ""},
    ),
    (
        "(if(isnull(z100(ofi_60s)) | isnull(lag5(z100(ofi_60s))), null, if(((sgn(z100(ofi_60s)) != sgn(lag5(z100(ofi_60s)))) & (z100(ofi_60s) != 0)) & (lag5(z100(ofi_60s)) != 0), 1, 0)) * delta5(z100(ofi_60s))) * if(isnull(mean100(quoted_spread_ticks)), null, if(quoted_spread_ticks < mean100(quoted_spread_ticks), 1, 0))",
        {"ofi_zvel_thin_gate": ""},
    ),
    (
        "(if(isnull(z100(oir)) | isnull(lag5(z100(oir))), null, if(((sgn(z100(oir)) != sgn(lag5(z100(oir)))) & (z100(oir) != 0)) & (lag5(z100(oir)) != 0), 1, 0)) * delta5(z100(oir))) * if(isnull(mean100(rv_60s)), null, if(rv_60s > mean100(rv_60s), 1, 0))",
        {"oir_zcross_x_rvhi": ""},
    ),
    (
        "(if(isnull(z100(wdi)) | isnull(lag5(z100(wdi))), null, if(((sgn(z100(wdi)) != sgn(lag5(z100(wdi)))) & (z100(wdi) != 0)) & (lag5(z100(wdi)) != 0), 1, 0)) * delta5(z100(wdi))) * if(isnull(mean100(rv_60s)), null, if(rv_60s > mean100(rv_60s), 0, 1))",
        {"wdi_zcross_x_rvlo": ""},
    ),
    (
        "(if(isnull(z100(imb_full)) | isnull(lag5(z100(imb_full))), null, if(((sgn(z100(imb_full)) != sgn(lag5(z100(imb_full)))) & (z100(imb_full) != 0)) & (lag5(z100(imb_full)) != 0), 1, 0)) * delta5(z100(imb_full))) * if(isnull(mean100(rv_60s)), null, if(rv_60s > mean100(rv_60s), 1, -1))",
        {"fullbook_imb_zcross_x_rv_regime": ""},
    ),
    (
        "if((notnull(mean100(rv_300s * rv_300s) - (mean100(rv_300s) * mean100(rv_300s))) & ((mean100(rv_300s * rv_300s) - (mean100(rv_300s) * mean100(rv_300s))) > 1e-12)) & notnull(book_slope - (((mean100(book_slope * rv_300s) - (mean100(book_slope) * mean100(rv_300s))) / (mean100(rv_300s * rv_300s) - (mean100(rv_300s) * mean100(rv_300s)))) * rv_300s)), book_slope - (((mean100(book_slope * rv_300s) - (mean100(book_slope) * mean100(rv_300s))) / (mean100(rv_300s * rv_300s) - (mean100(rv_300s) * mean100(rv_300s)))) * rv_300s), null)",
        {"vol_adj_slope": ""},
    ),
    (
        "if(((cum_sum(if(delta1(high_px) > 0, 1, 0)) + cum_sum(if(delta1(low_px) < 0, 1, 0))) >= 1) & (((ts_ms - cum_max(if(if(delta1(high_px) > 0, 1, 0) > 0.5, ts_ms, 0))) + (ts_ms - cum_max(if(if(delta1(low_px) < 0, 1, 0) > 0.5, ts_ms, 0)))) > 1e-09), ((ts_ms - cum_max(if(if(delta1(low_px) < 0, 1, 0) > 0.5, ts_ms, 0))) - (ts_ms - cum_max(if(if(delta1(high_px) > 0, 1, 0) > 0.5, ts_ms, 0)))) / ((ts_ms - cum_max(if(if(delta1(high_px) > 0, 1, 0) > 0.5, ts_ms, 0))) + (ts_ms - cum_max(if(if(delta1(low_px) < 0, 1, 0) > 0.5, ts_ms, 0)))), null)",
        {"extreme_recency_asym": ""},
    ),
    (
        "if(isnull(if(isnull(z100(oir)) | isnull(lag5(z100(oir))), null, if(((sgn(z100(oir)) != sgn(lag5(z100(oir)))) & (z100(oir) != 0)) & (lag5(z100(oir)) != 0), 1, 0)) * delta5(z100(oir))) | isnull(trade_imbalance_60s), null, if(sgn(if(isnull(z100(oir)) | isnull(lag5(z100(oir))), null, if(((sgn(z100(oir)) != sgn(lag5(z100(oir)))) & (z100(oir) != 0)) & (lag5(z100(oir)) != 0), 1, 0)) * delta5(z100(oir))) = sgn(trade_imbalance_60s), 1, 0)) * (if(isnull(z100(oir)) | isnull(lag5(z100(oir))), null, if(((sgn(z100(oir)) != sgn(lag5(z100(oir)))) & (z100(oir) != 0)) & (lag5(z100(oir)) != 0), 1, 0)) * delta5(z100(oir)))",
        {"oir_zcross_x_ti_sign": ""},
    ),
    (
        "if(((((notnull(lag5(sum100((delta1(bid1_qty) < 0) & notnull(lead5(bid1_qty) - bid1_qty)))) & notnull(lag5(sum100((delta1(ask1_qty) < 0) & notnull(lead5(ask1_qty) - ask1_qty))))) & (lag5(sum100((delta1(bid1_qty) < 0) & notnull(lead5(bid1_qty) - bid1_qty))) >= 2)) & (lag5(sum100((delta1(ask1_qty) < 0) & notnull(lead5(ask1_qty) - ask1_qty))) >= 2)) & notnull(lag5(mean100(bid1_qty + ask1_qty)))) & (lag5(mean100(bid1_qty + ask1_qty)) > 0), ((lag5(sum100(if((delta1(bid1_qty) < 0) & notnull(lead5(bid1_qty) - bid1_qty), lead5(bid1_qty) - bid1_qty, 0))) / lag5(sum100((delta1(bid1_qty) < 0) & notnull(lead5(bid1_qty) - bid1_qty)))) - (lag5(sum100(if((delta1(ask1_qty) < 0) & notnull(lead5(ask1_qty) - ask1_qty), lead5(ask1_qty) - ask1_qty, 0))) / lag5(sum100((delta1(ask1_qty) < 0) & notnull(lead5(ask1_qty) - ask1_qty))))) / lag5(mean100(bid1_qty + ask1_qty)), null)",
        {"queue_refill_asym_300s": ""},
    ),
]


@cache
def signals() -> dict[str, Node]:
    found: dict[str, Node] = {}
    for name, text in SIGNALS.items():
        found[name] = substitute(parse(text), found)
    return found


@cache
def formulas() -> dict[str, Node]:
    """Prototype -> formula over panel columns."""
    out = {}
    for text, members in RULES:
        rule = parse(text)
        for name, args in members.items():
            given = {f"x{i}": ("col", a) for i, a in enumerate(args.split(), 1)}
            out[name] = substitute(substitute(rule, given), signals())
    return dict(sorted(out.items()))
